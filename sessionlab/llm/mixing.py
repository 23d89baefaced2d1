"""Mixing sources to target weights by systematic sampling, DataFrame operations only.

Every document of a source is expected target / source size times. Along the documents of a source, ordered by size, the expected
copies are summed up, one offset per source is added, and a document comes out once for every whole number that its step passes.
Ordering by size makes neighbours alike, so the words taken stay within about one document's size of the target.

Defined results: null texts have size 0 and are mixed like others; a null source is a source of its own, last in order; repeated rows
are separate documents; an empty table gives an empty one; a source of size 0 has target 0 and gives nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlab.session import broadcast_if_small, cut_lineage

from .common import WORD, numbered, running_sums

#: Copies are counted in whole parts of this size, so that sums are exact in any order and fit a long up to 1e11 documents a source.
UNIT = 1 << 24


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("bigint"), F.lit(0).cast("bigint"))


def source_key(source):
    """Source as a text that is never null and sorts by code point, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3) -> DataFrame:
    """(source_key, source_size, docs, target) from rows (source_key, size).

    Weights repeat along the ordered sources and share the total size. Where a share is above ``cap`` times the source's size the target
    stops there and the excess goes to the rest by weight, until none is above. Sources sorted by the level at which they reach their cap
    form a prefix of full ones, so two running sums give the level of the rest without repeating the sharing.
    """
    per = sizes.groupBy("source_key").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs")).withColumn("one", F.lit(1))
    numbered = running_sums(per, ["source_key"], ["one"])
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("before_one") % len(weights) + 1).cast("int"))
    capped = numbered.select("source_key", "source_size", "docs", weight.alias("weight"), (F.col("source_size") * cap).alias("cap"))
    capped = cut_lineage(capped.withColumn("full_at", F.col("cap") / F.col("weight")))
    whole = capped.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    level = (F.lit(whole["size"]) - F.col("before_cap")) / (F.lit(whole["weight"]) - F.col("before_weight"))
    filled = cut_lineage(running_sums(capped, ["full_at", "source_key"], ["cap", "weight"]).withColumn("level", level))
    rest = filled.where("level < full_at").agg(F.min_by("level", F.struct("full_at", "source_key")).alias("level")).first()["level"]
    full = F.col("level") >= F.col("full_at")
    target = F.when(full, F.col("cap").cast("double")).otherwise(F.col("weight") * F.lit(rest))
    return filled.select("source_key", "source_size", "docs", F.coalesce(target, F.lit(0.0)).cast("double").alias("target"))


def offset(key, seed: int):
    """A fixed offset in [0, UNIT) for each source."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key).cast("binary")), 1, 6), 16, 10).cast("bigint")


def systematic_copies(rows: DataFrame, order: list[str], seed: int = 17) -> DataFrame:
    """Add ``copies`` to rows with ``source_key`` and ``parts`` (expected copies in units of 1 / UNIT)."""
    summed = running_sums(rows, order, ["parts"], by=["source_key"])
    start = F.col("before_parts") + offset(F.col("source_key"), seed)
    copies = F.expr(f"(before_parts + _offset + parts) div {UNIT} - (before_parts + _offset) div {UNIT}")
    return summed.withColumn("_offset", start - F.col("before_parts")).withColumn("copies", copies).drop("_offset", "before_parts")


def plan(rows: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3, seed: int = 17) -> DataFrame:
    """Add source_size, target and copies to narrow rows (row, doc_id, source_key, size); ``row`` tells rows apart."""
    goal = targets(rows, weights, cap)
    parts = F.coalesce(F.expr(f"bigint(floor(target / nullif(source_size, 0) * {UNIT}))"), F.lit(0))
    rows = rows.join(goal.select("source_key", "source_size", "target"), "source_key").withColumn("parts", parts)
    rows = rows.withColumn("doc_order", F.coalesce("doc_id", F.lit(-(2**63))))
    return systematic_copies(rows, ["size", "doc_order", "row"], seed).drop("parts", "doc_order")


def narrow(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> list:
    return [F.col(id_col).cast("bigint").alias("doc_id"), source_key(F.col(source_col)).alias("source_key"), word_count(F.col(text_col)).alias("size")]


def mixture_plan(docs: DataFrame, **options) -> DataFrame:
    """One row for every document: row, doc_id, source_key, size, source_size, target, copies."""
    return plan(cut_lineage(docs.select(*narrow(docs)).withColumn("row", F.monotonically_increasing_id())), **options)


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: the rows of ``docs`` with all their columns, each as often as it was drawn."""
    rows, number = numbered(docs)
    drawn = plan(cut_lineage(rows.select(*narrow(rows), F.col(number).alias("row"))), **options).where("copies > 0")
    drawn = cut_lineage(drawn.select(F.col("row").alias(number), F.col("copies").cast("int").alias(f"{number}_copies")))
    repeated = rows.join(broadcast_if_small(drawn), number).withColumn(f"{number}_copies", F.expr(f"sequence(1, {number}_copies)"))
    return repeated.select(*docs.columns, F.explode(f"{number}_copies").alias(f"{number}_copy")).drop(f"{number}_copy")
