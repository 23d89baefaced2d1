"""Unions, distinct keys and requirement checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def union_sessions(parts: Sequence[DataFrame]) -> DataFrame:
    """Union of sessions whose columns differ."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def distinct_sessions(df: DataFrame, keys: Sequence[str], min_participant: int | None = None) -> DataFrame:
    out = df.select(*keys)
    if min_participant is not None:
        out = out.where(F.col(keys[0]).try_cast("long") >= min_participant)
    return out.distinct()


def labels_present(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    """Labels of truth or prediction; each side collapses before the union."""
    a = df.select(F.col(truth).alias("label")).distinct()
    return a.union(df.select(F.col(prediction).alias("label")).distinct()).distinct()


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def missing_keys(required: DataFrame, available: DataFrame) -> DataFrame:
    """Required rows that are not available."""
    return required.exceptAll(available.distinct())


def total_order(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Range-partitioned total order."""
    return df.orderBy(*keys)


def top_k(df: DataFrame, by: Sequence[str], score, k: int, tie: Sequence[str] = ()) -> DataFrame:
    """k rows with the largest score per group; the rank limit is applied before the shuffle."""
    w = Window.partitionBy(*by).orderBy(score.desc(), *tie)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def rank_by(df: DataFrame, score, tie: Sequence[str] = ()) -> DataFrame:
    """Every row with its rank over all rows, however many: ranges are ordered, and a range's rank starts after the rows before it."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [score, *tie]
    dealt = cut_lineage(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    before = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.withColumn("_inside", inside).join(before, "_part").select(*df.columns, (F.col("_inside") + F.coalesce("_before", F.lit(0))).cast("int").alias("rank"))


def best_per(df: DataFrame, name: str, criteria: dict[str, str]) -> DataFrame:
    """Winner per criterion; ``criteria`` maps a column to ``max`` or ``min``; ties go to the smaller name."""
    rows = []
    for col, side in criteria.items():
        score = F.col(col) if side == "max" else -F.col(col)
        best = F.min(F.when(score.isNotNull(), F.struct((-score).alias("s"), F.col(name).alias("n"), F.col(col).alias("v"))))
        rows.append(F.struct(F.lit(col).alias("criterion"), best["n"].alias(name), best["v"].cast("double").alias("value")))
    return df.agg(F.array(*rows).alias("_r")).select(F.inline("_r"))
