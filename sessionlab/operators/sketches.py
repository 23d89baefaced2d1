"""Quantiles from mergeable sketches: one small KLL sketch per session and column, written once, merged as often as wanted.

Sessions that arrive later add their own sketches; groups, the whole and every left-out fold are merges, no second scan of the rows. The rank error
of a merged sketch follows ``k``, not the number of merges: about 2.3 / k^0.9 for a single rank, 0.6 % at the default. Up to k values are held exactly.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .quantile import melt

K = 800


def rank_error(k: int = K) -> float:
    """Share of rows by which a quantile's rank may be off, with 99 % confidence."""
    return 2.3 / k**0.9


def sketch(df: DataFrame, by: Sequence[str], cols: Sequence[str], k: int = K) -> DataFrame:
    """(by..., column, sketch): combinable, so rows are summed up before they travel. Nulls and NaN are left out; a group without values has no row."""
    return melt(df, by, cols).groupBy(*by, "column").agg(F.kll_sketch_agg_double("value", k).alias("sketch"))


def _read(sketch: str | Column, probs: Sequence[float]) -> list[Column]:
    q = F.kll_sketch_get_quantile_double(sketch, F.array(*[F.lit(float(p)) for p in probs]))
    return [F.kll_sketch_get_n_double(sketch).alias("n"), *[q[i].alias(f"q{i}") for i in range(len(probs))]]


def quantiles(sketches: DataFrame, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by..., column, n, q0, ...) of the rows of any coarser grouping."""
    return sketches.groupBy(*by, "column").agg(F.kll_merge_agg_double("sketch").alias("sketch")).select(*by, "column", *_read("sketch", probs))


def _both(a: Column, b: Column) -> Column:
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.kll_sketch_merge_double(a, b))


def leave_one_out_quantiles(sketches: DataFrame, fold: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """(fold..., column, n, q0, ...) of all rows outside each fold.

    Sketches can't be subtracted, so what lies before and after a fold is merged. Folds are dealt to about as many blocks as a block has folds;
    running merges go forward and back inside a block, and over the blocks, so no task holds more than the root of all folds. A single fold has nothing outside: n = 0 and null quantiles.
    Fold keys may be null.
    """
    fold = list(fold)
    one = cut_lineage(sketches)
    blocks = isqrt(max(one.groupBy("column").count().agg(F.max("count")).first()[0] or 1, 1)) + 1
    dealt = one.withColumn("_b", F.pmod(F.xxhash64(*fold), F.lit(blocks)))

    def around(df, group, order):
        out = df
        for name, way in (("_before", [F.col(c).asc() for c in order]), ("_after", [F.col(c).desc() for c in order])):
            w = Window.partitionBy(*group).orderBy(*way).rowsBetween(Window.unboundedPreceding, -1)
            running = F.kll_merge_agg_double("sketch").over(w)
            first = F.row_number().over(Window.partitionBy(*group).orderBy(*way)) == 1
            out = out.withColumn(name, F.when(~first, running))
        return out.withColumn("_rest", _both(F.col("_before"), F.col("_after"))).drop("_before", "_after")

    inside = around(dealt, ["column", "_b"], fold)
    whole = dealt.groupBy("column", "_b").agg(F.kll_merge_agg_double("sketch").alias("sketch"))
    outside = around(whole, ["column"], ["_b"]).select("column", "_b", F.col("_rest").alias("_other"))
    out = inside.join(outside, ["column", "_b"]).select(*fold, "column", _both(F.col("_rest"), F.col("_other")).alias("sketch"))
    n, *q = _read("sketch", probs)
    return out.select(*fold, "column", F.coalesce(n, F.lit(0)).alias("n"), *q)


def robust_fit_folds(sketches: DataFrame, fold: Sequence[str]) -> DataFrame:
    """(fold..., column, center, scale): median and interquartile range of the training rows of every left-out fold; a zero range counts as 1."""
    q = leave_one_out_quantiles(sketches, fold, [0.25, 0.5, 0.75]).where("n > 0")
    spread = F.col("q2") - F.col("q0")
    return q.select(*fold, "column", F.col("q1").alias("center"), F.when(spread == 0, 1.0).otherwise(spread).alias("scale"))
