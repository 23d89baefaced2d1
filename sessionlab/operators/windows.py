"""Row-count and time windows over sessions and their statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import explode_range, scan

STATS = {
    "mean": F.avg,
    "std": F.stddev_pop,
    "min": F.min,
    "max": F.max,
    "median": F.median,
}


def with_rank(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "rn", chunk_width: float | None = None
) -> DataFrame:
    """0-based position of every row in its session."""
    chunk = None if chunk_width is None else F.floor(F.col(order[0]) / F.lit(float(chunk_width)))
    ranked = scan(df, keys, order, {name: ("rank",)}, chunk=chunk)
    return ranked.withColumn(name, F.col(name) - 1)


def row_windows(df: DataFrame, keys: Sequence[str], order: Sequence[str], size, step, chunk_width: float | None = None) -> DataFrame:
    """One row per (row, covering window): adds rn and window_id.

    ``size`` and ``step`` are numbers or Columns (adaptive per participant).  Incomplete windows
    are still present; aggregate with ``complete``.
    """
    size = size if isinstance(size, Column) else F.lit(int(size))
    step = step if isinstance(step, Column) else F.lit(int(step))
    r = with_rank(df, keys, order, chunk_width=chunk_width).withColumns({"_w": size, "_st": step})
    first = F.greatest(F.lit(0), F.ceil((F.col("rn") - F.col("_w") + 1) / F.col("_st")))
    last = F.floor(F.col("rn") / F.col("_st"))
    return r.where(first <= last).withColumn("window_id", F.explode(F.sequence(first, last)))


def majority(label: str) -> Column:
    """Most frequent code, the smallest one on ties."""
    return F.mode(label, True)


def window_stats(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    cols: Sequence[str],
    size,
    step,
    stats: Sequence[str] = ("mean", "std", "min", "max", "median"),
    label: str | None = None,
    drop_null_labels: bool = False,
    chunk_width: float | None = None,
) -> DataFrame:
    """Statistics of complete row windows; with ``label`` also its majority code."""
    w = row_windows(df, keys, order, size, step, chunk_width)
    aggs = [STATS[s](c).alias(f"{c}_{s}") for c in cols for s in stats]
    aggs += [F.min(order[0]).alias("start"), F.max(order[0]).alias("end"), F.count(F.lit(1)).alias("_n"), F.first("_w").alias("_size")]
    if label:
        aggs += [majority(label).alias(label), F.count(label).alias("_nl")]
    out = w.groupBy(*keys, "window_id").agg(*aggs).where("_n = _size")
    if label and drop_null_labels:
        out = out.where("_nl = _n")
    return out.drop("_n", "_size", "_nl")


def block_window_stats(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str], size: int, step: int
) -> DataFrame:
    """Mean, std, min and max of heavily overlapping windows by way of shared blocks.

    Rows aggregate once into blocks of gcd(size, step); a window combines size/block of them,
    so a 99 % overlap costs size/step block rows, not size/step copies of every raw row.
    """
    b = gcd(size, step)
    r = with_rank(df, keys, order).withColumn("_blk", F.floor(F.col("rn") / b))
    aggs = [F.count(F.lit(1)).alias("_n"), F.min(order[0]).alias("_t")]
    for c in cols:
        aggs += [
            F.count(c).alias(f"_c_{c}"), F.avg(c).alias(f"_m_{c}"), F.var_pop(c).alias(f"_v_{c}"),
            F.min(c).alias(f"_lo_{c}"), F.max(c).alias(f"_hi_{c}"),
        ]
    blocks = r.groupBy(*keys, "_blk").agg(*aggs)
    per, hop = size // b, step // b
    first = F.greatest(F.lit(0), F.ceil((F.col("_blk") - per + 1) / hop))
    last = F.floor(F.col("_blk") / hop)
    spread = blocks.where(first <= last).withColumn("window_id", F.explode(F.sequence(first, last)))
    outs = [F.sum("_n").alias("_n"), F.min("_t").alias("start")]
    for c in cols:
        n, m, v = F.col(f"_c_{c}"), F.col(f"_m_{c}"), F.col(f"_v_{c}")
        outs += [
            (F.sum(n * m) / F.sum(n)).alias(f"{c}_mean"),
            # between-block part as a weighted variance of block means: no large cancellation for one block
            F.sum(n * v).alias(f"_w_{c}"),
            F.sum(n).alias(f"_c_{c}"),
            F.collect_list(F.struct(n.alias("n"), m.alias("m"))).alias(f"_l_{c}"),
            F.min(f"_lo_{c}").alias(f"{c}_min"),
            F.max(f"_hi_{c}").alias(f"{c}_max"),
        ]
    out = spread.groupBy(*keys, "window_id").agg(*outs).where(F.col("_n") == size)
    for c in cols:
        mean = F.col(f"{c}_mean")
        between = F.aggregate(
            F.transform(f"_l_{c}", lambda x: x["n"] * (x["m"] - mean) * (x["m"] - mean)), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))
        )
        out = out.withColumn(f"{c}_std", F.sqrt((F.col(f"_w_{c}") + between) / F.col(f"_c_{c}")))
    return out.select(*keys, "window_id", "start", *[f"{c}_{s}" for c in cols for s in ("mean", "std", "min", "max")])


def window_arrays(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str], size: int, step: int, label: str | None = None) -> DataFrame:
    """Complete windows as an ordered array of row vectors (at most ``size`` rows per group)."""
    w = row_windows(df, keys, order, size, step)
    item = F.struct("rn", F.array(*[F.col(c).cast("float") for c in cols]).alias("x"))
    aggs = [F.array_sort(F.collect_list(item)).alias("_rows"), F.min(order[0]).alias("start"), F.max(order[0]).alias("end")]
    if label:
        aggs.append(majority(label).alias(label))
    out = w.groupBy(*keys, "window_id").agg(*aggs).where(F.size("_rows") == size)
    return out.withColumn("features", F.transform("_rows", lambda r: r["x"])).drop("_rows")


def count_windows(n: Column, size: int, step: int) -> Column:
    """Closed-form number of complete windows in ``n`` rows."""
    return F.when(n >= size, F.floor((n - size) / step) + 1).otherwise(F.lit(0)).cast("long")


def first_window(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: int) -> DataFrame:
    """Rows of the first window of each session."""
    return with_rank(df, keys, order).where(F.col("rn") < size)


def adaptive(sizes: Mapping[str, tuple[int, int]], key: str) -> tuple[Column, Column]:
    """(size, step) Columns from a configuration keyed by participant with a ``default`` entry."""
    size, step = F.lit(sizes["default"][0]), F.lit(sizes["default"][1])
    for who, (w, s) in sizes.items():
        if who != "default":
            size = F.when(F.col(key).cast("string") == who, w).otherwise(size)
            step = F.when(F.col(key).cast("string") == who, s).otherwise(step)
    return size, step


def time_windows(bounds: DataFrame, keys: Sequence[str], lo: str, hi: str, size: float, step: float) -> DataFrame:
    """Full half-open windows [start, start+size) from each session's lower bound."""
    last = F.floor((F.col(hi) - F.col(lo) - size) / step)
    out = explode_range(bounds, F.lit(0), last, "window_id")
    start = F.col(lo) + F.col("window_id") * F.lit(float(step))
    return out.select(*keys, "window_id", start.alias("start"), (start + F.lit(float(size))).alias("end"))


def covering_windows(rows: DataFrame, time: str, lo: str, hi: str, size: float, step: float) -> DataFrame:
    """Rows with the id of every time window that covers them (computed, not joined)."""
    rel = F.col(time) - F.col(lo)
    first = F.greatest(F.lit(0), F.floor((rel - size) / step) + 1)
    last = F.least(F.floor(rel / step), F.floor((F.col(hi) - F.col(lo) - size) / step))
    return rows.where((rel >= 0) & (first <= last)).withColumn("window_id", F.explode(F.sequence(first, last)))


def block_average(rows: DataFrame, group: Sequence[str], rn: str, cols: Sequence[str], factor: int) -> DataFrame:
    """Means of consecutive blocks of ``factor`` rows inside a window; a partial last block is dropped."""
    b = rows.withColumn("block", F.floor(F.col(rn) / factor))
    out = b.groupBy(*group, "block").agg(F.count(F.lit(1)).alias("_n"), *[F.avg(c).alias(c) for c in cols])
    return out.where(F.col("_n") == factor).drop("_n")


def fix_length(seq: Column, n: int, pad: Column) -> Column:
    """Most recent ``n`` items of an array, padded in front."""
    short = F.concat(F.array_repeat(pad, F.greatest(F.lit(0), F.lit(n) - F.size(seq))), seq)
    return F.slice(short, F.size(short) - n + 1, n)


def in_group_rank(rows: DataFrame, group: Sequence[str], order: Sequence[str], name: str = "rn") -> DataFrame:
    """0-based position inside a group that is bounded by construction (a window)."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1)


def moving_mean(col: str, group: Sequence[str], order: Sequence[str], half: int = 3) -> Column:
    """Centred mean over ``half`` rows each side, truncated at the edges of a bounded group."""
    return F.avg(col).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(-half, half))


def min_samples(hz: float, seconds: float, min_coverage: float) -> int:
    """Samples a window needs: half-even rounded share of the expected count, at least 2, at most 8 below 1 Hz."""
    need = max(2, round(hz * seconds * min_coverage))
    return max(2, min(need, 8)) if hz < 1 else need


def window_series(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str], size: int, step: int
) -> DataFrame:
    """Complete windows with one ordered array per column (at most ``size`` values each)."""
    w = row_windows(df, keys, order, size, step)
    rows = F.array_sort(F.collect_list(F.struct("rn", *[F.col(c).cast("double").alias(c) for c in cols])))
    out = w.groupBy(*keys, "window_id").agg(rows.alias("_rows"), F.min(order[0]).alias("start")).where(F.size("_rows") == size)
    return out.withColumns({c: F.col("_rows").getField(c) for c in cols}).drop("_rows")
