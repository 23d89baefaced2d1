"""Exact quantiles without gathering a column in one task.

``percentile`` keeps every distinct value of a group in one buffer, so a whole-table median
does not scale.  Here a first pass counts rows in monotone buckets (map-side combined), the
buckets that hold the wanted ranks are picked, and only their values are ranked.  The
answer is the linearly interpolated quantile, the same as ``percentile``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, cut_lineage
from .ordered import scan

COARSE = 256  # buckets per factor of two
FINE = 4096  # sub-buckets per coarse bucket


def _scale(value: Column) -> Column:
    """Monotone log-like position of a double: equal relative width everywhere."""
    magnitude = F.log2(F.abs(value)) + F.lit(1080.0)
    return F.when(value == 0, F.lit(0.0)).when(value > 0, magnitude).otherwise(-magnitude)


def melt(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Long form (by..., column, value) without nulls; one scan for all columns."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in cols])
    return (
        df.select(*by, F.explode(pairs).alias("_p"))
        .select(*by, F.col("_p.column").alias("column"), F.col("_p.value").alias("value"))
        .where(F.col("value").isNotNull() & ~F.isnan("value"))
    )


def quantiles(
    df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str] = (), approximate: bool = False
) -> DataFrame:
    """Rows (by..., column, n, q0, q1, ...) with one q per probability.

    ``approximate`` trades exactness for one pass with bounded mergeable sketches.
    """
    by = list(by)
    group = [*by, "column"]
    long = melt(df, by, cols)
    if approximate:
        sketch = long.groupBy(*group).agg(
            F.count(F.lit(1)).alias("n"), F.percentile_approx("value", [float(p) for p in probs], 10_000).alias("_q")
        )
        return sketch.select(*group, "n", *[F.col("_q")[i].alias(f"q{i}") for i in range(len(probs))])

    long = long.withColumn("_b", bucket(F.col("value")))
    hist = long.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_c"))
    target = known_small(target_buckets(hist, group, probs), by)
    # equal values collapse before the shuffle, so copies of one value cost nothing
    values = long.join(target, [*group, "_b"]).groupBy(*group, "_b", "value", "n", "_below").agg(F.count(F.lit(1)).alias("_c"))
    return select_ranks(values, group, probs)


def known_small(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """A table of a few rows per group and column, ready to join without shuffling the data.

    Without groups its size is fixed by the column list.  With groups it is written once, and
    broadcast only if the written size is small.
    """
    return broadcast_if_small(cut_lineage(df)) if by else F.broadcast(df)


def bucket(value: Column) -> Column:
    return F.floor(_scale(value) * COARSE)


def _ranks(probs: Sequence[float]) -> tuple[list[Column], list[Column]]:
    """Per probability the 0-based rank floor(p (n - 1)), and that rank followed by the next one."""
    low = [F.floor(F.lit(float(p)) * (F.col("n") - 1)) for p in probs]
    return low, [r for base in low for r in (base, F.least(base + 1, F.col("n") - 1))]


def target_buckets(hist: DataFrame, group: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """(group..., _b, n, _below): the buckets that hold a wanted rank, from counts ``_c`` per bucket."""
    ordered = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hist = hist.withColumns({"_cum": F.sum("_c").over(ordered), "n": F.sum("_c").over(Window.partitionBy(*group))})
    hit = F.lit(False)
    for r in _ranks(probs)[1]:
        hit = hit | ((r >= F.col("_cum") - F.col("_c")) & (r < F.col("_cum")))
    return hist.where(hit).select(*group, "_b", "n", (F.col("_cum") - F.col("_c")).alias("_below"))


def select_ranks(values: DataFrame, group: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Interpolated quantiles from the distinct values (with counts ``_c``) of the target buckets.

    A bucket is ranked through its fine cells, so no window holds a whole bucket.
    """
    low, wanted = _ranks(probs)
    values = values.withColumn("_f", F.floor(_scale(F.col("value")) * (COARSE * FINE)))
    cell = [*group, "_b", "_f"]
    fine = values.groupBy(*cell).agg(F.sum("_c").alias("_fc"))
    before = Window.partitionBy(*group, "_b").orderBy("_f").rowsBetween(Window.unboundedPreceding, -1)
    fine = fine.withColumn("_fbelow", F.coalesce(F.sum("_fc").over(before), F.lit(0))).drop("_fc")
    inner = Window.partitionBy(*cell).orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = values.withColumn("_in", F.sum("_c").over(inner)).join(fine, cell)
    ranked = ranked.withColumn("_hi", F.col("_below") + F.col("_fbelow") + F.col("_in")).withColumn("_lo", F.col("_hi") - F.col("_c"))
    at = [F.max(F.when((r >= F.col("_lo")) & (r < F.col("_hi")), F.col("value"))).alias(f"_a{i}") for i, r in enumerate(wanted)]
    picked = ranked.groupBy(*group, "n").agg(*at)
    return _interpolated(picked, group, probs, low)


def _interpolated(picked: DataFrame, group: Sequence[str], probs: Sequence[float], low: Sequence[Column]) -> DataFrame:
    out = []
    for i, p in enumerate(probs):
        frac = F.lit(float(p)) * (F.col("n") - 1) - low[i]
        a, b = F.col(f"_a{2 * i}"), F.col(f"_a{2 * i + 1}")
        out.append((a + (b - a) * frac).alias(f"q{i}"))
    return picked.select(*group, "n", *out)


def leave_one_out_quantiles(df: DataFrame, fold: Sequence[str], cols: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Quantiles of all rows outside each fold, for every fold in one job: (fold..., column, n, q0, ...).

    A rank outside a fold is a rank among all rows: with j of the fold's own rows before it, rank r outside is rank r + j overall. So distinct
    values get their overall ranks once, each fold counts its own rows before the wanted places, and the places are looked up
    in the order of all values. The work grows with rows and folds, not with their product.
    """
    fold = list(fold)
    own = cut_lineage(melt(df, fold, cols).groupBy(*fold, "column", "value").agg(F.count(F.lit(1)).alias("_c")))
    every = scan(own.groupBy("column", "value").agg(F.sum("_c").alias("_t")), ["column"], ["value"], {"_upto": ("cumsum", "_t")})
    every = cut_lineage(every)
    group = [*fold, "column"]
    mine = scan(own.join(every.select("column", "value", "_upto"), ["column", "value"]), group, ["value"], {"_o": ("cumsum", "_c")})
    total = every.groupBy("column").agg(F.sum("_t").alias("_all"))
    sizes = own.dropna(subset=fold).groupBy(*group).agg(F.sum("_c").alias("_n"))
    n = sizes.join(F.broadcast(total), "column").select(*group, (F.col("_all") - F.col("_n")).alias("n")).where("n > 0")
    low, wanted = _ranks(probs)
    # rows outside the fold up to an own value: if no more than the rank, the wanted place comes after that value
    before = [F.coalesce(F.sum(F.when(F.col("_upto") - F.col("_o") <= r, F.col("_c"))), F.lit(0)) for r in wanted]
    places = mine.join(n, group).groupBy(*group, "n").agg(*[(F.first(r) + b).alias(f"_p{i}") for i, (r, b) in enumerate(zip(wanted, before))])
    places = cut_lineage(places)
    asked = places.select("column", F.explode(F.array(*[F.col(f"_p{i}") for i in range(len(wanted))])).alias("_at")).distinct()
    order = every.select("column", (F.col("_upto") - F.col("_t")).alias("_at"), F.lit(0).alias("_asks"), "value")
    order = order.unionByName(asked.select("column", "_at", F.lit(1).alias("_asks"), F.lit(None).cast("double").alias("value")))
    # the value at a place is the last one that begins there or before
    at = scan(order, ["column"], ["_at", "_asks"], {"_found": ("last", "value")}).where("_asks = 1").select("column", "_at", "_found")
    each = places.select(*group, "n", F.posexplode(F.array(*[F.col(f"_p{i}") for i in range(len(wanted))])).alias("_i", "_at")).join(at, ["column", "_at"])
    picked = each.groupBy(*group, "n").agg(*[F.max(F.when(F.col("_i") == i, F.col("_found"))).alias(f"_a{i}") for i in range(len(wanted))])
    return _interpolated(picked, group, probs, low)


def wide_quantiles(quantile_rows: DataFrame, cols: Sequence[str], names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """One row per group with columns ``<col>_<name>``."""
    aggs = [
        F.max(F.when(F.col("column") == c, F.col(f"q{i}"))).alias(f"{c}_{name}") for c in cols for i, name in enumerate(names)
    ]
    return quantile_rows.groupBy(*by).agg(*aggs)


def medians(df: DataFrame, cols: Sequence[str]) -> dict[str, float | None]:
    """Fitted per-column medians (driver-side parameters, one number per column)."""
    found = {r["column"]: r["q0"] for r in quantiles(df, cols, [0.5]).collect()}
    return {c: found.get(c) for c in cols}
