"""Markers, resampling, filling, runs and thinning of session streams."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import explode_range, measure, scan, steps, with_chunk
from .quantile import medians

CK = "_ck"


# ---------------------------------------------------------------- markers and intervals
def marker_intervals(
    markers: DataFrame, labels: Sequence[str], keys: Sequence[str], time: str, marker: str, pos: str
) -> DataFrame:
    """Closed label intervals (keys..., start, end, label, ord, t0), times relative to t0.

    A ``start_x`` opens (a second one overwrites), an ``end_x`` closes if open, in file order
    ``pos``.  ``t0`` is the start of the first interval to close.
    """
    text = F.lower(F.col(marker))
    m = markers.select(*keys, F.col(time).cast("double").alias("_t"), F.col(pos).alias("ord"), text.alias("_m"))
    m = m.withColumn("label", F.explode(F.array(*[F.lit(x) for x in labels])))
    kind = F.when(F.contains("_m", F.concat(F.lit("start_"), "label")), 1).when(
        F.contains("_m", F.concat(F.lit("end_"), "label")), 0
    )
    m = m.withColumn("_open", kind).where(F.col("_open").isNotNull())
    m = scan(
        m,
        [*keys, "label"],
        ["ord"],
        {
            "_s": ("before", F.when(F.col("_open") == 1, F.struct("ord", "_t"))),
            "_e": ("before", F.when(F.col("_open") == 0, F.col("ord"))),
        },
    )
    closed = m.where((F.col("_open") == 0) & F.col("_s").isNotNull() & (F.col("_e").isNull() | (F.col("_s.ord") > F.col("_e"))))
    closed = closed.select(*keys, F.col("_s._t").alias("start"), F.col("_t").alias("end"), "label", "ord")
    origin = closed.groupBy(*keys).agg(F.min_by("start", "ord").alias("t0"))
    return closed.join(origin, list(keys)).select(
        *keys, (F.col("start") - F.col("t0")).alias("start"), (F.col("end") - F.col("t0")).alias("end"), "label", "ord", "t0"
    )


def marker_intervals_by_position(
    markers: DataFrame, labels: Sequence[str], keys: Sequence[str], time: str, marker: str, pos: str
) -> DataFrame:
    """Pair the i-th ``start_x`` with the i-th ``end_x`` (exact names) of each label."""
    m = markers.select(*keys, F.col(time).alias("_t"), F.col(pos).alias("_p"), F.col(marker).alias("_m"))
    named = [(f"{kind}_{x}", kind, x) for x in labels for kind in ("start", "end")]
    m = m.where(F.col("_m").isin([n for n, _, _ in named]))
    m = m.select(
        *keys, "_t", "_p", F.substring_index("_m", "_", 1).alias("kind"), F.expr("substr(_m, instr(_m, '_') + 1)").alias("label")
    )
    m = scan(m, [*keys, "label", "kind"], ["_p"], {"i": ("rank",)})
    paired = m.groupBy(*keys, "label", "i").agg(
        F.max(F.when(F.col("kind") == "start", F.col("_t"))).alias("start"),
        F.max(F.when(F.col("kind") == "end", F.col("_t"))).alias("end"),
    )
    return paired.where(F.col("start").isNotNull() & F.col("end").isNotNull())


def augment_intervals(intervals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add the pre_fatigue (activity to fatigue) and unlabeled (baseline to activity) gaps."""

    def latest(col, label):
        return F.max_by(col, F.when(F.col("label") == label, F.col("ord")))

    b = intervals.groupBy(*keys).agg(
        latest("end", "baseline").alias("_be"),
        latest("start", "activity").alias("_as"),
        latest("end", "activity").alias("_ae"),
        latest("start", "fatigue").alias("_fs"),
        F.max("ord").alias("_last"),
    )
    gaps = F.array(
        F.struct(F.col("_ae").alias("s"), F.col("_fs").alias("e"), F.lit("pre_fatigue").alias("l"), (F.col("_last") + 1).alias("o")),
        F.struct(F.col("_be").alias("s"), F.col("_as").alias("e"), F.lit("unlabeled").alias("l"), (F.col("_last") + 2).alias("o")),
    )
    extra = b.select(*keys, F.explode(gaps).alias("g")).where("g.s < g.e")
    extra = extra.select(
        *keys, F.col("g.s").alias("start"), F.col("g.e").alias("end"), F.col("g.l").alias("label"), F.col("g.o").alias("ord")
    )
    return intervals.select(*keys, "start", "end", "label", "ord").unionByName(extra)


# ---------------------------------------------------------------- resampling to a fixed grid
def resample_mean(
    df: DataFrame, keys: Sequence[str], time: str, cols: Sequence[str], period: float, gaps: bool = True
) -> DataFrame:
    """Mean per bin ``floor(t / period) * period``; with ``gaps`` empty bins appear as null rows."""
    binned = df.groupBy(*keys, F.floor(F.col(time) / period).alias("_b")).agg(*[F.avg(c).alias(c) for c in cols])
    if not gaps:
        return binned.select(*keys, (F.col("_b") * F.lit(float(period))).alias(time), *cols)
    nxt = scan(binned, keys, ["_b"], {"_n": ("after", "_b")})
    grid = explode_range(nxt, F.col("_b"), F.coalesce(F.col("_n") - 1, F.col("_b")), "_g")
    here = F.col("_g") == F.col("_b")
    return grid.select(*keys, (F.col("_g") * F.lit(float(period))).alias(time), *[F.when(here, F.col(c)).alias(c) for c in cols])


def _lead_in(df: DataFrame, keys: Sequence[str], time: str, period: float, first: str) -> DataFrame:
    """Grid rows from the session's first bin up to the first bin that has a value."""
    lo = df.groupBy(*keys).agg(F.floor(F.min(time) / period).alias("_lo"), F.min(first).alias("_f"))
    return explode_range(lo, F.col("_lo"), F.col("_f") - 1, "_g").select(*keys, "_g")


def resample_ffill(df: DataFrame, keys: Sequence[str], time: str, cols: Sequence[str], period: float) -> DataFrame:
    """Value at a bin is the latest observation at or before it; bins before the first are null.

    Each observation writes the bins up to its successor, so no grid join is needed.
    """
    obs = scan(df, keys, [time], {"_nt": ("after", time)})
    first = F.ceil(F.col(time) / period)
    last = F.when(F.col("_nt").isNull(), F.floor(F.col(time) / period)).otherwise(F.ceil(F.col("_nt") / period) - 1)
    filled = explode_range(obs, first, last, "_g").select(*keys, "_g", *cols)
    lead = _lead_in(df.withColumn("_c", F.ceil(F.col(time) / period)), keys, time, period, "_c")
    # a session whose only bins lie before its first whole bin still keeps its first bin
    out = filled.unionByName(lead, allowMissingColumns=True)
    return out.select(*keys, (F.col("_g") * F.lit(float(period))).alias(time), *cols)


def resample_linear(
    df: DataFrame, keys: Sequence[str], time: str, cols: Sequence[str], period: float, mode: str = "time"
) -> DataFrame:
    """Linear interpolation on the grid.

    ``time`` interpolates between real observations; ``exact`` uses only observations that lie
    on the grid (then carries the last one), all bins staying null if there is none.
    """
    if mode == "exact":
        ends = df.groupBy(*keys).agg(F.floor(F.min(time) / period).alias("_lo"), F.floor(F.max(time) / period).alias("_hi"))
        onto = df.withColumn("_g0", F.floor(F.col(time) / period)).where(F.col("_g0") * F.lit(float(period)) == F.col(time))
        nxt = scan(onto, keys, ["_g0"], {"_n": ("after", F.struct("_g0", *cols))})
        nxt = nxt.join(ends, list(keys))
        body = explode_range(nxt, F.col("_g0"), F.coalesce(F.col("_n._g0") - 1, F.col("_hi")), "_g")
        share = (F.col("_g") - F.col("_g0")) / (F.col("_n._g0") - F.col("_g0"))
        body = body.select(*keys, "_g", *[F.coalesce(F.col(c) + (F.col(f"_n.{c}") - F.col(c)) * share, F.col(c)).alias(c) for c in cols])
        firsts = onto.groupBy(*keys).agg(F.min("_g0").alias("_f"))
        head = ends.join(firsts, list(keys), "left")
        lead = explode_range(head, F.col("_lo"), F.coalesce(F.col("_f") - 1, F.col("_hi")), "_g").select(*keys, "_g")
        out = body.unionByName(lead, allowMissingColumns=True)
    elif mode == "time":
        nxt = scan(df, keys, [time], {"_n": ("after", F.struct(time, *cols))})
        first = F.ceil(F.col(time) / period)
        last = F.when(F.col("_n").isNull(), F.floor(F.col(time) / period)).otherwise(F.ceil(F.col(f"_n.{time}") / period) - 1)
        body = explode_range(nxt, first, last, "_g")
        share = (F.col("_g") * F.lit(float(period)) - F.col(time)) / (F.col(f"_n.{time}") - F.col(time))
        body = body.select(*keys, "_g", *[F.coalesce(F.col(c) + (F.col(f"_n.{c}") - F.col(c)) * share, F.col(c)).alias(c) for c in cols])
        lead = _lead_in(df.withColumn("_c", F.ceil(F.col(time) / period)), keys, time, period, "_c")
        out = body.unionByName(lead, allowMissingColumns=True)
    else:
        raise ValueError(f"unknown mode: {mode}")
    return out.select(*keys, (F.col("_g") * F.lit(float(period))).alias(time), *cols)


def resample_auto(
    df: DataFrame, keys: Sequence[str], time: str, cols: Sequence[str], native_hz: float, target_hz: float, mode: str = "time"
) -> DataFrame:
    """Pick the resampler from the native rate: mean at or above the target, ffill below 1 Hz, else linear."""
    period = 1000.0 / target_hz
    if native_hz >= target_hz:
        return resample_mean(df, keys, time, cols, period)
    if native_hz < 1:
        return resample_ffill(df, keys, time, cols, period)
    return resample_linear(df, keys, time, cols, period, mode)


# ---------------------------------------------------------------- filling
def ffill_bfill(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str], global_median: bool = True
) -> DataFrame:
    """Forward then backward fill per session; what stays null takes the column's median."""
    exprs = {}
    for c in cols:
        exprs[f"_f_{c}"] = ("last", c)
        exprs[f"_b_{c}"] = ("next", c)
    filled = scan(df, keys, order, exprs)
    fallback = medians(df, cols) if global_median else {}
    new = {
        c: F.coalesce(F.col(f"_f_{c}"), F.col(f"_b_{c}"), *([F.lit(fallback[c])] if fallback.get(c) is not None else []))
        for c in cols
    }
    return filled.withColumns(new).select(*df.columns)


def interpolate_limited(df: DataFrame, keys: Sequence[str], order: str, col: str, limit: int) -> DataFrame:
    """Interpolate by row position, at most ``limit`` rows from a real value, then ffill and bfill.

    Adds ``<col>_missing`` (1.0 where the input was null).
    """
    base = measure(df, keys, order, CK)
    base = scan(base, keys, [order], {"_r": ("rank",)}, premeasured=CK)
    known = F.when(F.col(col).isNotNull(), F.struct(F.col("_r").alias("r"), F.col(col).alias("v")))
    base = scan(base, keys, [order], {"_p": ("last", known), "_n": ("next", known)}, premeasured=CK)
    ahead, behind = F.col("_r") - F.col("_p.r"), F.col("_n.r") - F.col("_r")
    at = F.when((ahead <= limit) | (behind <= limit), ahead).otherwise(F.lit(limit))
    lerp = F.col("_p.v") + (F.col("_n.v") - F.col("_p.v")) * at / (ahead + behind)
    value = F.coalesce(F.col(col), lerp, F.col("_p.v"), F.col("_n.v"))
    return base.select(
        *[c for c in df.columns if c != col], value.alias(col), F.col(col).isNull().cast("double").alias(f"{col}_missing")
    )


def positive_steps(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Positive first differences of the clock."""
    return steps(df, keys, order).where("step > 0")


# ---------------------------------------------------------------- runs
def label_runs(df: DataFrame, keys: Sequence[str], time: str, label: str) -> DataFrame:
    """Maximal stretches of equal label: (keys..., run, start, end, label, n); the last run is closed."""
    base = measure(df.select(*keys, time, label), keys, time, CK)
    base = scan(base, keys, [time], {"_pl": ("before", F.struct(F.col(label).alias("l")))}, premeasured=CK)
    change = (F.col("_pl").isNull() | ~F.col("_pl.l").eqNullSafe(F.col(label))).cast("long")
    base = scan(base.withColumn("_chg", change), keys, [time], {"run": ("cumsum", "_chg")}, premeasured=CK)
    return base.groupBy(*keys, "run").agg(
        F.min(time).alias("start"), F.max(time).alias("end"), F.first(label).alias(label), F.count(F.lit(1)).alias("n")
    )


# ---------------------------------------------------------------- greedy thinning
def _jumps(ts: np.ndarray, period: float) -> np.ndarray:
    return np.maximum(np.searchsorted(ts, ts + period, side="left"), np.arange(len(ts)) + 1)


def thin_min_gap(df: DataFrame, keys: Sequence[str], time: str, period: float) -> DataFrame:
    """Keep a stamp only if it is at least ``period`` after the last kept one.

    Greedy and sequential, yet chunked: inside a chunk every possible first kept row (those
    within one period of its start) is followed to the last row it keeps; the chunk summaries
    are chained per session; then each chunk replays its own part. Sessions of one chunk are only replayed, many in
    one pass of a task over sorted rows. Rows whose keys are null belong to no session and are left out.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(time).cast("double").alias("_t")).dropna(subset=keys).distinct()
    base = with_chunk(rows, keys, "_t", name=CK, long_flag="_long")
    ktypes = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in base.select(*keys).schema)

    def follow(key, pdf):
        ts = np.sort(pdf["_t"].to_numpy())
        jump = _jumps(ts, period)
        entries = np.flatnonzero(ts < ts[0] + period)
        entries = np.append(entries, entries[-1] + 1) if entries[-1] + 1 < len(ts) else entries
        exits = []
        for i in entries:
            while jump[i] < len(ts):
                i = jump[i]
            exits.append(ts[i])
        out = pd.DataFrame({CK: key[-1], "_entry": ts[entries], "_exit": exits, "_end": ts[-1]})
        for i, k in enumerate(keys):
            out.insert(i, k, key[i])
        return out

    summary = base.where("_long").select(*keys, "_t", CK).groupBy(*keys, CK).applyInPandas(follow, f"{ktypes}, {CK} long, _entry double, _exit double, _end double")

    def chain(key, pdf):
        last, rows = -np.inf, []
        for ck, part in pdf.sort_values([CK, "_entry"]).groupby(CK, sort=True):
            ok = part[part["_entry"] >= last + period]
            if len(ok):
                first = ok.iloc[0]
                rows.append((*key, int(ck), float(first["_entry"])))
                last = float(first["_exit"])
        return pd.DataFrame(rows, columns=[*keys, CK, "_from"])

    starts = summary.groupBy(*keys).applyInPandas(chain, f"{ktypes}, {CK} long, _from double")

    def replay(batches):
        now, last, n = None, None, len(keys) + 1
        for batch in batches:
            kept = []
            for *key, t, start in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if key != now:
                    now, last = key, None
                if t is None or t != t:  # stamps that are none come last and are kept
                    kept.append(True)
                    continue
                kept.append(t >= last + period if last is not None else start is None or t >= start)
                last = t if kept[-1] else last
            out = batch.filter(pa.array(kept, pa.bool_()))
            yield pa.RecordBatch.from_arrays([*out.columns[: n - 1], out.column(n)], [*keys, time])

    placed = base.join(starts, [*keys, CK], "left").where("NOT _long OR _from IS NOT NULL").select(*keys, CK, "_t", "_from")
    dealt = placed.repartition(*keys, CK).sortWithinPartitions(*keys, CK, F.col("_t").asc_nulls_last())
    return dealt.mapInArrow(replay, f"{ktypes}, {time} double")
