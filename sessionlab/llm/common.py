"""Helpers shared by the operators: words, hashes, Arrow batches, running sums over a global order, components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sessionlab.session import cut_lineage

#: Rows handled at a time inside an Arrow batch, so that Python copies stay small beside the batch.
SLICE_ROWS = 256
#: Words that a worker remembers before it starts afresh, and the longest it remembers: together they bound a cache in bytes.
CACHE_WORDS, CACHE_LENGTH = 200_000, 64
#: Text bytes handled at a time inside an Arrow batch; a longer text comes alone.
SLICE_BYTES = 4 << 20
#: Java and Python form of the word pattern: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of a text column, empty for null. ``bytes.split()`` splits at exactly the white space of WORD."""
    return [t or b"" for t in batch.column(name).cast(pa.binary()).to_pylist()]


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Parts of at most ``rows`` rows whose ``text`` column, if there is one, holds about SLICE_BYTES at most."""
    for batch in batches:
        ends = None
        if "text" in batch.schema.names:
            sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            to = min(at + rows, batch.num_rows)
            if ends is not None:
                before = int(ends[at - 1]) if at else 0
                to = min(to, max(at + 1, int(np.searchsorted(ends, before + SLICE_BYTES, side="right"))))
            yield batch.slice(at, to - at)
            at = to


def arrow_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


class WordHashes(dict):
    """Word to 64-bit hash; looks like a dict so that ``map(hashes.__getitem__, words)`` runs in C."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= CACHE_LENGTH:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


#: One for all operators, since a worker serves several of them in turn; ``worker_cache`` empties it when a worker turns to another model.
WORD_HASHES = WordHashes()


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` words; a sequence of fewer words counts as one run, none gives nothing."""
    if not len(h):
        return h
    k = min(k, len(h))
    n = len(h) - k + 1
    out = np.full(n, k, dtype=np.uint64)
    for j in range(k):
        out = mix64(out + h[j : j + n])
    return out


def running_sums(
    df: DataFrame, order: list[str], sums: list[str], by: list[str] = (), parts: int | None = None, last: list[str] = ()
) -> DataFrame:
    """Exclusive running sums ``before_<c>`` over the order (within ``by``) and, for ``last``, the latest non-null value so far.

    Rows are dealt by range, so a hot ``by`` key spreads over many tasks; only one summary row per range and key is carried on.
    Order columns must tell rows apart, else equal rows land in one range. The dealt rows are written once, so a task that runs
    again sees the same ranges. ``by`` columns must not be null.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*by, *order]
    dealt = cut_lineage(df.repartitionByRange(n, *keys).withColumn("_part", F.spark_partition_id()))
    at_end = F.struct(*order)
    per = dealt.groupBy("_part", *by).agg(
        *[F.sum(c).alias(f"_sum_{c}") for c in sums], *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), at_end)).alias(f"_last_{c}") for c in last]
    )
    earlier = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    carry = per.select(
        F.col("_part").alias("_carry_part"), *[F.col(b).alias(f"_carry_{b}") for b in by],
        *[F.coalesce(F.sum(f"_sum_{c}").over(earlier), F.lit(0)).alias(f"_base_{c}") for c in sums],
        *[F.last(f"_last_{c}", ignorenulls=True).over(earlier).alias(f"_held_{c}") for c in last],
    )
    inside = W.partitionBy("_part", *by).orderBy(*order)
    prior = inside.rowsBetween(W.unboundedPreceding, -1)
    so_far = inside.rowsBetween(W.unboundedPreceding, 0)
    match = reduce(lambda a, b: a & b, [F.col(b) == F.col(f"_carry_{b}") for b in by], F.col("_part") == F.col("_carry_part"))
    out = dealt.select(
        "*", *[F.coalesce(F.sum(c).over(prior), F.lit(0)).alias(f"_in_{c}") for c in sums],
        *[F.last(c, ignorenulls=True).over(so_far).alias(f"_seen_{c}") for c in last],
    ).join(carry, match)
    return out.select(
        *df.columns, *[(F.col(f"_in_{c}") + F.col(f"_base_{c}")).alias(f"before_{c}") for c in sums],
        *[F.coalesce(f"_seen_{c}", f"_held_{c}").alias(f"last_{c}") for c in last],
    )


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for the ends of undirected edges (a, b); component is the smallest node reachable.

    Alternating large-star and small-star steps: each step is two combinable minima and joins, so a vertex with very many
    edges never has to sit in one task. Edges are written after every round; rounds grow with the logarithm of the longest path.
    """
    now = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(max_rounds):
        # large star: every larger neighbour of x points to the smallest node around x
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m"))
        large = both.join(low, both["u"] == low["x"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: every smaller neighbour of x, and x itself, point to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), "m")
        joined = large.join(least, large["u"] == least["x"])
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select(F.col("x").alias("u"), F.col("m").alias("v")))
        now = cut_lineage(small.where("u <> v").distinct())
        # settled once all are stars: a node with one centre that has no centre itself
        ends = now.select(F.col("u").alias("x"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionAll(now.select("v", F.lit(0), F.lit(1)))
        if ends.groupBy("x").agg(F.sum("below").alias("below"), F.max("above").alias("above")).where("below + above > 1").isEmpty():
            roots = now.select(F.col("v").alias("node")).distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots.select("node", F.col("node").alias("component")))
    raise RuntimeError(f"components have not settled after {max_rounds} rounds")


def crc32_mod(column, n: int):
    """crc32 of the id as text, modulo n; null ids count as the text 'null'."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("null")).cast("binary")) % n


def numbered(df: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a number each, written once so that the numbers last, and the name of that column, which no other column has."""
    name = f"_row_{uuid.uuid4().hex[:12]}"
    return cut_lineage(df.select("*", F.monotonically_increasing_id().alias(name))), name


def smallest_hashes(df: DataFrame, columns: list[str], most: int) -> DataFrame:
    """At most ``most`` rows, those whose columns have the smallest hashes.

    A counting pass first sets a hash limit that about three times as many rows stay under, so each task hands on a few rows, not
    ``most``, however many tasks there are.
    """
    share = min(1.0, 3 * most / max(df.count(), 1))
    hashed = df.withColumn("_hash", F.xxhash64(*columns)).where(F.col("_hash") <= min(2**63 - 1, int(-(2**63) + share * 2**64)))
    return hashed.orderBy("_hash", *columns).limit(most).drop("_hash")


def worker_cache(store: dict, key, make: Callable):
    """A worker keeps one object per kind; another key replaces it."""
    if key not in store:
        store.clear()
        WORD_HASHES.clear()
        store[key] = make()
    return store[key]
