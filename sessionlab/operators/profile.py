"""Quality report and descriptive statistics of a signal table.

Each section is one DataFrame.  Counts and moments are hash aggregates; quantiles use the
two-pass exact selection, so no section gathers a column or a session in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import TARGET_PERIOD_MS
from ..session import broadcast_if_small
from .ordered import steps
from .quantile import known_small, melt, quantiles


def sample_skewness(x: Column) -> Column:
    """Bias-corrected skewness; null below three values."""
    n = F.count(x)
    return F.when(n >= 3, F.skewness(x) * F.sqrt(n * (n - 1.0)) / (n - 2.0))


def sample_kurtosis(x: Column) -> Column:
    """Bias-corrected excess kurtosis; null below four values."""
    n = F.count(x)
    return F.when(n >= 4, (n - 1.0) / ((n - 2.0) * (n - 3.0)) * ((n + 1.0) * F.kurtosis(x) + 6.0))


def profile_overview(df: DataFrame) -> DataFrame:
    """Rows, columns, size estimate in bytes and how many columns have each type."""
    width = {"double": 8, "bigint": 8, "int": 4, "float": 4, "tinyint": 1, "timestamp": 8, "boolean": 1}
    kinds: dict[str, int] = {}
    per_row = F.lit(0)
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        kinds[kind] = kinds.get(kind, 0) + 1
        per_row = per_row + (F.lit(width[kind]) if kind in width else F.coalesce(F.length(F.col(f.name).cast("string")), F.lit(0)))
    totals = df.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(per_row), F.lit(0)).alias("size_bytes"))
    pairs = F.array(*[F.struct(F.lit(k).alias("type"), F.lit(v).alias("n_of_type")) for k, v in sorted(kinds.items())])
    return totals.select("n_rows", F.lit(len(df.columns)).alias("n_columns"), "size_bytes", F.inline(pairs))


def head_tail(df: DataFrame, order: Sequence[str], n: int = 5) -> DataFrame:
    """First and last rows in a stated order (top-k, not a full sort)."""
    head = df.orderBy(*order).limit(n).withColumn("part", F.lit("head"))
    tail = df.orderBy(*[F.col(c).desc() for c in order]).limit(n).withColumn("part", F.lit("tail"))
    return head.unionByName(tail)


def profile_missing(df: DataFrame) -> DataFrame:
    """Missing count and percent per column, with the table's totals, in one pass."""
    any_null = F.lit(False)
    for c in df.columns:
        any_null = any_null | F.col(c).isNull()
    row = df.agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(any_null).alias("rows_with_missing"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]
    )
    total = sum((F.col(c) for c in df.columns), F.lit(0))
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_missing")) for c in df.columns])
    out = row.select("_n", "rows_with_missing", total.alias("total_missing"), F.inline(pairs))
    return out.withColumn("percent", F.round(F.col("n_missing") / F.col("_n") * 100, 2)).drop("_n")


def profile_duplicates(df: DataFrame, time: str) -> DataFrame:
    """Repeated rows, repeated stamps and rows sharing a stamp, with percents."""
    exact = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_c")).agg(F.sum("_c").alias("n_rows"), F.sum(F.col("_c") - 1).alias("exact"))
    stamps = df.groupBy(time).agg(F.count(F.lit(1)).alias("_c")).agg(
        F.sum(F.col("_c") - 1).alias("by_time"), F.sum(F.when(F.col("_c") > 1, F.col("_c")).otherwise(0)).alias("rows_involved")
    )
    both = exact.withColumn("_k", F.lit(1)).join(broadcast_if_small(stamps.withColumn("_k", F.lit(1))), "_k").drop("_k")
    return both.withColumns({"exact_percent": F.col("exact") / F.col("n_rows") * 100, "time_percent": F.col("by_time") / F.col("n_rows") * 100})


def duplicates_by_group(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Groups that contain exact repeats, with their number."""
    counts = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_c"))
    return counts.groupBy(*by).agg(F.sum(F.col("_c") - 1).alias("n_duplicates")).where("n_duplicates > 0")


def duplicated_stamps(df: DataFrame, time: str, order: Sequence[str], n: int = 10) -> DataFrame:
    """A few rows whose stamp occurs more than once, for inspection."""
    repeated = df.groupBy(time).agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").drop("_c")
    return df.join(repeated, time, "left_semi").orderBy(*order).limit(n)


def profile_stats(df: DataFrame, cols: Sequence[str], decimals: int = 3, approximate: bool = False) -> DataFrame:
    """count, mean, std (n-1), min, quartiles, median, max, skewness and kurtosis per column."""
    moments = melt(df, [], cols).groupBy("column").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
        F.max("value").alias("max"), sample_skewness(F.col("value")).alias("skewness"), sample_kurtosis(F.col("value")).alias("kurtosis"),
    )
    q = quantiles(df, cols, [0.25, 0.5, 0.75], approximate=approximate)
    q = q.select("column", F.col("q0").alias("q25"), F.col("q1").alias("median"), F.col("q2").alias("q75"))
    out = moments.join(F.broadcast(q), "column")  # one row per column
    names = ["mean", "std", "min", "q25", "median", "q75", "max", "skewness", "kurtosis"]
    return out.select("column", "count", *[F.round(n, decimals).alias(n) for n in names])


def profile_labels(df: DataFrame, label: str) -> DataFrame:
    """Rows and percent per label and whether the classes are balanced (spread below 10 points)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    one = Window.partitionBy()  # a handful of label rows
    pct = F.col("n") * 100.0 / F.sum("n").over(one)
    out = counts.withColumn("percent", pct)
    spread = F.max("percent").over(one) - F.min("percent").over(one)
    return out.withColumns({"balanced": spread < 10, "percent": F.round("percent", 2)})


def profile_participants(df: DataFrame, participant: str, session: str) -> DataFrame:
    """Rows and distinct sessions; a first aggregate per session keeps hot participants parallel."""
    per = df.groupBy(participant, session).agg(F.count(F.lit(1)).alias("_c"))
    return per.groupBy(participant).agg(F.sum("_c").alias("n"), F.count(session).alias("n_sessions"))


def profile_sessions(df: DataFrame, by: Sequence[str], label: str) -> DataFrame:
    """Rows per session with its label histogram as a map."""
    per = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("_c"))
    return per.groupBy(*by).agg(
        F.sum("_c").alias("n"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(label), F.col("_c"))))).alias("labels")
    )


def profile_continuity(df: DataFrame, by: Sequence[str], time: str, period: float = TARGET_PERIOD_MS) -> DataFrame:
    """Positive steps per session: mean, min, max and jumps over twice the period."""
    pos = steps(df.select(*by, time), by, time).where("step > 0")
    return pos.groupBy(*by).agg(
        F.avg("step").alias("mean_step"), F.min("step").alias("min_step"), F.max("step").alias("max_step"),
        F.count_if(F.col("step") > 2 * period).alias("n_jumps"),
    )


def profile_outliers(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), approximate: bool = False) -> DataFrame:
    """Rows strictly outside 1.5 IQR per column: count, percent of all values, min, max."""
    by = list(by)
    q = quantiles(df, cols, [0.25, 0.75], by=by, approximate=approximate)
    iqr = F.col("q1") - F.col("q0")
    bounds = q.select(*by, "column", (F.col("q0") - 1.5 * iqr).alias("_lo"), (F.col("q1") + 1.5 * iqr).alias("_hi"))
    out = melt(df, by, cols).join(known_small(bounds, by), [*by, "column"])
    return out.groupBy(*by, "column").agg(
        F.count_if((F.col("value") < F.col("_lo")) | (F.col("value") > F.col("_hi"))).alias("n_outliers"),
        F.count(F.lit(1)).alias("n"), F.min("value").alias("min"), F.max("value").alias("max"),
    ).withColumn("percent", F.col("n_outliers") / F.col("n") * 100)


def corr_matrix(df: DataFrame, cols: Sequence[str], decimals: int = 3) -> DataFrame:
    """Pearson correlations of the lower triangle, pairwise complete, in one aggregate."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[:i]]
    entries = F.array(
        *[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.corr(a, b), decimals).alias("r")) for a, b in pairs]
    )
    return df.agg(entries.alias("_e")).select(F.inline("_e"))


def stats_by_label(df: DataFrame, label: str, cols: Sequence[str], decimals: int = 3) -> DataFrame:
    return melt(df, [label], cols).groupBy(label, "column").agg(
        F.round(F.avg("value"), decimals).alias("mean"), F.round(F.stddev_samp("value"), decimals).alias("std"),
        F.round(F.min("value"), decimals).alias("min"), F.round(F.max("value"), decimals).alias("max"),
    )


def profile_time(df: DataFrame, time: str) -> DataFrame:
    """Clock range in ms, as timestamps, and hours covered."""
    r = df.agg(F.min(time).alias("min_ms"), F.max(time).alias("max_ms"))
    return r.withColumns(
        {
            "min_time": F.timestamp_millis(F.col("min_ms").cast("long")),
            "max_time": F.timestamp_millis(F.col("max_ms").cast("long")),
            "hours": F.round((F.col("max_ms") - F.col("min_ms")) / 3_600_000.0, 2),
        }
    )


def profile_summary(df: DataFrame, participant: str, session: str, time: str, label: str, n_signals: int) -> DataFrame:
    """Verdict table: one row per check with a pass/warn flag."""
    exact = profile_duplicates(df, time).select(F.lit(1).alias("_k"), "n_rows", "exact", "by_time")
    missing = profile_missing(df).agg(F.max("total_missing").alias("missing")).withColumn("_k", F.lit(1))
    labels = profile_labels(df, label).agg(F.max(F.col("balanced").cast("int")).alias("balanced")).withColumn("_k", F.lit(1))
    who = df.select(participant, session).distinct().agg(
        F.count_distinct(participant).alias("participants"), F.count_distinct(session).alias("sessions")
    ).withColumn("_k", F.lit(1))
    one = exact.join(broadcast_if_small(missing), "_k").join(broadcast_if_small(labels), "_k").join(broadcast_if_small(who), "_k")

    def line(name, value, ok):
        return F.struct(F.lit(name).alias("check"), value.cast("long").alias("value"), ok.alias("ok"))

    true = F.lit(True)
    rows = F.array(
        line("rows", F.col("n_rows"), true), line("participants", F.col("participants"), true), line("sessions", F.col("sessions"), true),
        line("signals", F.lit(n_signals), true), line("duplicates", F.col("exact"), F.col("exact") == 0),
        line("duplicate_stamps", F.col("by_time"), F.col("by_time") == 0), line("missing", F.col("missing"), F.col("missing") == 0),
        line("balanced", F.col("balanced"), F.col("balanced") == 1),
    )
    return one.select(F.inline(rows))


def support_pivot(df: DataFrame, participant: str, label: str, values: Sequence[int]) -> DataFrame:
    """Rows per participant and label, labels as columns, 0 where absent."""
    return df.groupBy(participant).agg(*[F.count_if(F.col(label) == v).alias(f"label_{v}".replace("-", "m")) for v in values])


def label_counts_by_session(df: DataFrame, by: Sequence[str], label: str) -> DataFrame:
    """Counts per session and label, ordered numerically where the keys are numbers."""
    out = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))
    return out.orderBy(*[F.col(k).try_cast("long") for k in by], *by, label)


def participant_profile(df: DataFrame, participant: str, cols: Sequence[str]) -> DataFrame:
    """Mean and std (n-1) of every signal, null as 0."""
    aggs = [f(c).alias(f"{c}_{n}") for c in cols for n, f in (("mean", F.avg), ("std", F.stddev_samp))]
    return df.groupBy(participant).agg(*aggs).fillna(0.0)


def median_by_label(df: DataFrame, label: str, cols: Sequence[str]) -> DataFrame:
    """Exact medians, one row per label."""
    q = quantiles(df, cols, [0.5], by=[label])
    return q.groupBy(label).agg(*[F.max(F.when(F.col("column") == c, F.col("q0"))).alias(f"{c}_median") for c in cols])


def box_stats(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Quartiles, whiskers at the last value inside 1.5 IQR, and number of fliers per group."""
    by = list(by)
    q = quantiles(df, cols, [0.25, 0.5, 0.75], by=by)
    iqr = F.col("q2") - F.col("q0")
    q = q.withColumns({"_lo": F.col("q0") - 1.5 * iqr, "_hi": F.col("q2") + 1.5 * iqr})
    inside = F.col("value").between(F.col("_lo"), F.col("_hi"))
    v = melt(df, by, cols).join(known_small(q, by), [*by, "column"])
    return v.groupBy(*by, "column").agg(
        F.first("q0").alias("q1"), F.first("q1").alias("median"), F.first("q2").alias("q3"),
        F.min(F.when(inside, F.col("value"))).alias("whisker_low"), F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
        F.count_if(~inside).alias("n_fliers"),
    )


def means_by(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(*[F.avg(c).alias(f"{c}_mean") for c in cols])


def freq_mean(df: DataFrame, by: Sequence[str], time: str) -> DataFrame:
    """Sampling rate in Hz from the mean step: (n - 1) / (max - min), no ordering needed."""
    r = df.groupBy(*by).agg(F.count(time).alias("_n"), (F.max(time) - F.min(time)).alias("_span"))
    return r.select(*by, F.when((F.col("_n") > 1) & (F.col("_span") > 0), (F.col("_n") - 1) * 1000.0 / F.col("_span")).alias("hz"))


def freq_median(df: DataFrame, by: Sequence[str], time: str) -> DataFrame:
    """Sampling rate in Hz from the median positive step; null if there is none."""
    pos = steps(df.select(*by, time), by, time).where("step > 0")
    med = quantiles(pos, ["step"], [0.5], by=by).select(*by, (1000.0 / F.col("q0")).alias("hz"))
    return df.select(*by).distinct().join(med, list(by), "left")


def median_step(df: DataFrame, by: Sequence[str], time: str) -> DataFrame:
    """Median positive step of a session, 0 if there is none."""
    pos = steps(df.select(*by, time), by, time).where("step > 0")
    med = quantiles(pos, ["step"], [0.5], by=by).select(*by, F.col("q0").alias("_m"))
    return df.select(*by).distinct().join(med, list(by), "left").select(*by, F.coalesce("_m", F.lit(0.0)).alias("median_step"))


def first_marker_times(markers: DataFrame, by: Sequence[str], time: str, marker: str, pos: str, names: Sequence[str]) -> DataFrame:
    """First stamp (file order) of every named marker per session."""
    return markers.groupBy(*by).agg(*[F.min_by(time, F.when(F.col(marker) == n, F.col(pos))).alias(n) for n in names])


def _phase_columns() -> dict[str, Column]:
    def span(a, b):
        return F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.greatest(F.lit(0.0), F.col(b) - F.col(a))).otherwise(F.lit(0.0))

    return {
        "baseline": span("start_baseline", "end_baseline"),
        "activity": span("start_activity", "end_activity"),
        "pre_fatigue": span("end_activity", "start_fatigue"),
        "fatigue": span("start_fatigue", "end_fatigue"),
    }


PHASE_MARKERS = [f"{k}_{p}" for p in ("baseline", "activity", "fatigue") for k in ("start", "end")]


def phase_durations(markers: DataFrame, by: Sequence[str], time: str, marker: str, pos: str) -> DataFrame:
    """Total duration of each phase over all sessions and its share in percent."""
    t = first_marker_times(markers, by, time, marker, pos, PHASE_MARKERS)
    sums = t.agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(n) for n, c in _phase_columns().items()])
    names = list(_phase_columns())
    total = sum((F.col(n) for n in names), F.lit(0.0))
    rows = F.array(
        *[
            F.struct(F.lit(n).alias("phase"), F.col(n).alias("duration"), F.when(total > 0, F.col(n) / total * 100).otherwise(0.0).alias("percent"))
            for n in names
        ]
    )
    return sums.select(F.inline(rows))


def training_usage(markers: DataFrame, ends: DataFrame, by: Sequence[str], time: str, marker: str, pos: str) -> DataFrame:
    """Used and unused time over the sessions that have all six markers; ``ends`` has (by..., session_end)."""
    t = first_marker_times(markers, by, time, marker, pos, PHASE_MARKERS).join(ends, list(by))
    complete = F.col("session_end").isNotNull()
    for m in PHASE_MARKERS:
        complete = complete & F.col(m).isNotNull()
    gap = F.greatest(F.lit(0.0), F.col("start_activity") - F.col("end_baseline"))
    rest = F.greatest(F.lit(0.0), F.col("session_end") - F.col("end_fatigue"))
    used = sum(_phase_columns().values(), F.lit(0.0))
    r = t.where(complete).agg(
        F.coalesce(F.sum(F.greatest(F.lit(0.0), F.col("session_end") - F.col("start_baseline"))), F.lit(0.0)).alias("total"),
        F.coalesce(F.sum(used), F.lit(0.0)).alias("used"), F.coalesce(F.sum(gap + rest), F.lit(0.0)).alias("unused"),
        F.count(F.lit(1)).alias("n_sessions"),
    )
    pct = {f"{c}_percent": F.when(F.col("total") > 0, F.col(c) / F.col("total") * 100).otherwise(0.0) for c in ("used", "unused")}
    return r.withColumns(pct)


def session_bounds(sensors: DataFrame, markers: DataFrame, by: Sequence[str], time: str, marker: str, end_marker: str = "end_session") -> DataFrame:
    """Start over markers and sensors; end from the end marker, else the last sensor stamp."""
    s = sensors.groupBy(*by).agg(F.min(time).alias("_smin"), F.max(time).alias("_smax"))
    m = markers.groupBy(*by).agg(F.min(time).alias("_mmin"), F.min(F.when(F.col(marker) == end_marker, F.col(time))).alias("_mend"))
    out = s.join(m, list(by), "full")
    return out.select(*by, F.least("_smin", "_mmin").alias("start"), F.coalesce("_mend", "_smax").alias("end"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights n / (k n_c) per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    one = Window.partitionBy()  # one row per class
    return counts.withColumn("weight", F.sum("n").over(one) / (F.count(F.lit(1)).over(one) * F.col("n")))


def with_class_weight(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    w = class_weights(df, label).select(label, F.col("weight").alias(name))
    return df.join(broadcast_if_small(w), label)


def summarize_folds(folds: DataFrame, by: Sequence[str], scores: Sequence[str]) -> DataFrame:
    """Mean, std (n-1), min, max of fold scores per model and the number of folds."""
    aggs = [F.count(F.lit(1)).alias("n_folds")]
    for s in scores:
        aggs += [F.avg(s).alias(f"{s}_mean"), F.stddev_samp(s).alias(f"{s}_std"), F.min(s).alias(f"{s}_min"), F.max(s).alias(f"{s}_max")]
    return folds.groupBy(*by).agg(*aggs)


def has_coverage(window_rows: DataFrame, by: Sequence[str], need: int) -> DataFrame:
    """Samples per window and whether they reach ``need`` (see ``windows.min_samples``)."""
    return window_rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).withColumn("covered", F.col("n") >= need)


def keep_one(df: DataFrame, keys: Sequence[str], order: str | Column, keep: str = "first") -> DataFrame:
    """One row per key by ``order``, as a combinable aggregate so a hot key never fills one task.

    ``keep='none'`` drops every row of a repeated key.
    """
    pick = F.max_by if keep == "last" else F.min_by
    rest = [c for c in df.columns if c not in keys]
    row = df.groupBy(*keys).agg(pick(F.struct(*rest), order).alias("_r"), F.count(F.lit(1)).alias("_c"))
    if keep == "none":
        row = row.where("_c = 1")
    return row.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)


def remove_duplicates(df: DataFrame, keys: Sequence[str], order: str | Column, keep: str = "first") -> DataFrame:
    """Exact repeats first, then repeats of (participant, session, timestamp)."""
    if keep == "none":
        exact = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_c")).where("_c = 1").drop("_c")
    else:
        exact = df.dropDuplicates()
    return keep_one(exact, keys, order, keep)


def overlap_rows(rows: DataFrame, intervals: DataFrame, labels: Sequence[str], by: Sequence[str], time: str) -> DataFrame:
    """Rows of each session that fall inside one of its intervals."""
    from .joins import label_rows

    return label_rows(rows, intervals, labels, by, time, outside="drop").groupBy(*by).agg(F.count(F.lit(1)).alias("rows_inside"))


