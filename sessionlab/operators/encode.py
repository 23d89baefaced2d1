"""Projections, encodings, filters and simple scalings of signal tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import LABEL_NAMES, UNLABELED, UNLABELED_CODE
from ..functions.text import clean
from ..session import broadcast_if_small
from .ordered import steps
from .quantile import quantiles


def project_map(df: DataFrame, mapping: Mapping[str, str], keep: Sequence[str] = ()) -> DataFrame:
    """Select and rename by map; sources that do not exist are ignored."""
    return df.select(*keep, *[F.col(src).alias(dst) for src, dst in mapping.items() if src in df.columns])


def coerce_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Cast to double; text that is no number and NaN become null."""

    def number(c):
        x = F.col(c).try_cast("double")
        return F.when(~F.isnan(x), x)

    return df.withColumns({c: number(c) for c in cols})


def lookup(col: Column, mapping: Mapping) -> Column:
    """Value of a small fixed mapping, null if unmapped."""
    out = F.lit(None)
    for k, v in mapping.items():
        out = F.when(col == F.lit(k), F.lit(v)).otherwise(out)
    return out


def encode_ordinal(df: DataFrame, mappings: Mapping[str, Mapping[str, int]]) -> DataFrame:
    """Trimmed lower-cased text to its code; unmapped text becomes null; absent columns are skipped."""
    return df.withColumns({c: lookup(clean(F.col(c)), m).cast("int") for c, m in mappings.items() if c in df.columns})


def encode_labels(df: DataFrame, label: str, mapping: Mapping[str, int], keep: int = UNLABELED_CODE) -> DataFrame:
    """Label text to tiny integer codes; ``unlabeled`` keeps its code, unknown and null labels are dropped."""
    code = lookup(F.col(label), {**mapping, UNLABELED: keep, str(keep): keep})
    return df.withColumn(label, code.cast("tinyint")).where(F.col(label).isNotNull())


def coerce_label(label: str) -> Column:
    return F.coalesce(F.col(label).try_cast("double").cast("int"), F.lit(UNLABELED_CODE))


def split_labeled(df: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """(labelled, unlabelled) rows; a label that is no number counts as unlabelled."""
    coded = df.withColumn(label, coerce_label(label))
    return coded.where(F.col(label) >= 0), coded.where(F.col(label) == UNLABELED_CODE)


def log1p_cols(df: DataFrame, cols: Sequence[str], clip: bool = False) -> DataFrame:
    return df.withColumns({c: F.log1p(F.greatest(F.col(c), F.lit(0.0)) if clip else F.col(c)) for c in cols})


def skew_report(df: DataFrame, cols: Sequence[str], clip: bool = False) -> DataFrame:
    """Bias-corrected skewness of each column before and after log1p."""
    from .profile import sample_skewness

    pairs = []
    for c in cols:
        x = F.greatest(F.col(c), F.lit(0.0)) if clip else F.col(c)
        pairs.append(
            F.struct(F.lit(c).alias("column"), sample_skewness(F.col(c)).alias("before"), sample_skewness(F.log1p(x)).alias("after"))
        )
    return df.agg(F.array(*pairs).alias("_p")).select(F.inline("_p"))


def drop_if_exists(df: DataFrame, *cols: str) -> DataFrame:
    return df.drop(*cols)


def reduce_precision(df: DataFrame, cols: Sequence[str], label: str | None = None) -> DataFrame:
    """Signals to float, label to tinyint."""
    new = {c: F.col(c).cast("float") for c in cols}
    if label:
        new[label] = F.col(label).cast("tinyint")
    return df.withColumns(new)


def precision_report(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Estimated bytes of the signal columns before and after."""
    return df.agg(
        (F.count(F.lit(1)) * F.lit(8 * len(cols))).alias("bytes_before"), (F.count(F.lit(1)) * F.lit(4 * len(cols))).alias("bytes_after")
    )


def session_origin(streams: Sequence[DataFrame], by: Sequence[str], time: str) -> DataFrame:
    """Earliest stamp of a session over markers and sensors."""
    mins = [s.groupBy(*by).agg(F.min(time).alias("_m")) for s in streams]
    out = mins[0]
    for m in mins[1:]:
        out = out.unionByName(m)
    return out.groupBy(*by).agg(F.min("_m").alias("t0"))


def relative_time(df: DataFrame, origins: DataFrame, by: Sequence[str], time: str) -> DataFrame:
    """Subtract the session origin; rows before it go negative."""
    out = df.join(broadcast_if_small(origins.select(*by, "t0")), list(by))
    return out.withColumn(time, F.col(time) - F.col("t0")).drop("t0")


def to_seconds_auto(df: DataFrame, by: Sequence[str], time: str) -> DataFrame:
    """Relative seconds; a session is in ms if its median positive step exceeds 10 or its clock 10 000."""
    pos = steps(df.select(*by, time), by, time).where("step > 0")
    med = quantiles(pos, ["step"], [0.5], by=by).select(*by, F.col("q0").alias("_med"))
    ends = df.groupBy(*by).agg(F.min(time).alias("_lo"), F.max(time).alias("_hi")).join(med, list(by), "left")
    rel = F.col(time) - F.col("_lo")
    ms = (F.coalesce(F.col("_med"), F.lit(0.0)) > 10) | (F.col("_hi") > 10_000)
    out = df.join(broadcast_if_small(ends), list(by)).withColumn("seconds", F.when(ms, rel / 1000.0).otherwise(rel))
    return out.drop("_lo", "_hi", "_med")


def clip_to_session(df: DataFrame, intervals: DataFrame, by: Sequence[str], time: str) -> DataFrame:
    """Rows between the first interval start and the last interval end, inclusive."""
    span = intervals.groupBy(*by).agg(F.min("start").alias("_s"), F.max("end").alias("_e"))
    return df.join(broadcast_if_small(span), list(by)).where(F.col(time).between(F.col("_s"), F.col("_e"))).drop("_s", "_e")


def split_cohort(df: DataFrame, key: str, ids: Iterable) -> tuple[DataFrame, DataFrame]:
    """(typical, atypical) rows by a list of atypical ids."""
    hit = F.col(key).isin(list(ids))
    return df.where(~hit), df.where(hit)


def is_blank(col: str) -> Column:
    return F.col(col).isNull() | (F.trim(F.col(col).cast("string")) == "")


def blank_keys(df: DataFrame, col: str, keys: Sequence[str]) -> DataFrame:
    return df.where(is_blank(col)).select(*keys).distinct()


def sanitize(df: DataFrame, cols: Sequence[str], limit: float) -> DataFrame:
    """NaN and null to 0, then clip to [-limit, limit] (infinities land on the bounds)."""
    return df.withColumns(
        {c: F.greatest(F.lit(-limit), F.least(F.lit(limit), F.nanvl(F.coalesce(F.col(c), F.lit(0.0)), F.lit(0.0)))) for c in cols}
    )


def fit_range(dfs: Sequence[DataFrame], cols: Sequence[str]) -> dict[str, tuple[float | None, float | None]]:
    """Smallest and largest value per column over all data sets (fitted parameters)."""
    rows = [df.agg(*[f(c).alias(f"{n}_{c}") for c in cols for n, f in (("lo", F.min), ("hi", F.max))]).first() for df in dfs]
    out = {}
    for c in cols:
        lo, hi = [r[f"lo_{c}"] for r in rows if r[f"lo_{c}"] is not None], [r[f"hi_{c}"] for r in rows if r[f"hi_{c}"] is not None]
        out[c] = (float(min(lo)), float(max(hi))) if lo else (None, None)
    return out


def apply_range(df: DataFrame, ranges: Mapping[str, tuple[float | None, float | None]]) -> DataFrame:
    new = {}
    for c, (lo, hi) in ranges.items():
        if lo is None:
            new[c] = F.lit(None).cast("double")
        elif lo == hi:
            new[c] = F.lit(0.5)
        else:
            new[c] = (F.col(c) - lo) / (hi - lo)
    return df.withColumns(new)


def minmax(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Scale to [0, 1]; an all-null column stays null, a constant one becomes 0.5."""
    return apply_range(df, fit_range([df], cols))


def minmax_shared(dfs: Sequence[DataFrame], cols: Sequence[str]) -> list[DataFrame]:
    """Scale several data sets with common bounds."""
    ranges = fit_range(dfs, cols)
    return [apply_range(df, ranges) for df in dfs]


def between_filter(df: DataFrame, col: str, lo: float, hi: float) -> DataFrame:
    return df.where(F.col(col).between(lo, hi))


def label_names(df: DataFrame, label: str, name: str = "label_name") -> DataFrame:
    return df.withColumn(name, lookup(F.col(label), LABEL_NAMES))


def one_hot(df: DataFrame, col: str, values: Sequence) -> DataFrame:
    """0/1 column per category value."""
    return df.withColumns({f"{col}_{v}": F.when(F.col(col) == F.lit(v), 1).otherwise(0) for v in values})


def categories(df: DataFrame, col: str) -> list:
    """Distinct values of a column that is to become 0/1 columns, in order: as many as the result is to have columns."""
    return sorted(r[0] for r in df.select(col).where(F.col(col).isNotNull()).distinct().collect())
