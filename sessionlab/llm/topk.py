"""Exact top-k inner products by norm-bucketed retrieval.

Vectors become whole numbers, floor(256 x). Candidates are dealt into buckets by length, so that equal lengths may split. A first meeting
with the longest bucket gives each query a score that its k-th best reaches at least. Then every block of queries meets the buckets that
are long enough for one of its queries: in a bucket, that score over both lengths is a local cosine threshold. Where it is high, a
candidate must lie in a feasible interval on each of the query's strongest coordinates (sorted per bucket and searched); where it is low, the
length alone cuts the bucket. What is left is verified by the exact product.

Products are computed in doubles where these are exact, else in 64-bit integers, else, for very large components, in Python's integers.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part, nor do rows without an id; whole
numbers beyond 2^62 count as 2^62 with their sign, and scores beyond 2^63 - 1 as that with theirs; vectors of different
dimension never meet; a query never meets its own row, but meets repeated rows; ties go to the smaller id; fewer than k candidates give
fewer rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sessionlab.session import cut_lineage

from .common import arrow_batch

BUCKET, QUERIES, FOCUS = 4096, 1024, 3
#: Local cosine above which coordinates prune better than length.
STEEP = 0.6
#: Whole numbers stop here, so that they fit 64 bits with room.
LIMIT = float(1 << 62)
MOST = 2**63 - 1
BLOCK = "block bigint, dim int, longest double, shortest double, ids binary, rows binary, vectors binary"
FOUND = "q_block bigint, query_row bigint, query_id bigint, vec_id bigint, cand_row bigint, score bigint"


def scaled(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(row, vec_id, v, norm2, dim) of the vectors that take part."""
    x = rows.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("x"), F.monotonically_increasing_id().alias("row"))
    usable = F.forall("x", lambda c: c.isNotNull() & (F.abs(c) < float("inf")) & ~F.isnan(c))
    x = x.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0) & usable)
    v = x.select("row", "vec_id", F.transform("x", lambda c: F.floor(F.greatest(F.least(c * 256, F.lit(LIMIT)), F.lit(-LIMIT))).cast("bigint")).alias("v"))
    return v.select("row", "vec_id", "v", F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double")).alias("norm2"), F.size("v").alias("dim"))


def blocks(vectors: DataFrame, size: int) -> DataFrame:
    """Blocks of about ``size`` vectors of like length, packed one to a row; written once."""
    count = vectors.count()
    schema = pa.schema([("block", pa.int64()), ("dim", pa.int32()), ("longest", pa.float64()), ("shortest", pa.float64()), ("ids", pa.binary()), ("rows", pa.binary()), ("vectors", pa.binary())])

    def run(batches):
        part, made = TaskContext.get().partitionId(), 0
        table = [b for b in batches if b.num_rows]
        if not table:
            return
        one = pa.Table.from_batches(table).combine_chunks()
        dims = one.column("dim").to_numpy()
        for dim in np.unique(dims):
            some = one.filter(pa.array(dims == dim))
            for at in range(0, some.num_rows, 2 * size):
                cut = some.slice(at, 2 * size).combine_chunks()
                v = cut.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dim)
                length = np.sqrt(cut.column("norm2").to_numpy().astype(float))
                ids, rows = cut.column("vec_id").to_numpy(), cut.column("row").to_numpy()
                yield arrow_batch(schema, [[part * (1 << 32) + made], [int(dim)], [length.max()], [length.min()], [ids.tobytes()], [rows.tobytes()], [np.ascontiguousarray(v).tobytes()]])
                made += 1

    dealt = vectors.repartitionByRange(max(1, -(-count // size)), F.col("dim"), F.col("norm2").desc(), F.col("vec_id"), F.col("row"))
    return cut_lineage(dealt.mapInArrow(run, BLOCK))


class Bucket:
    """Candidates of one bucket, longest first, with the sorted values of each coordinate of their unit vectors."""

    def __init__(self, dim: int, ids: bytes, rows: bytes, vectors: bytes):
        v = np.frombuffer(vectors, dtype=np.int64).reshape(-1, dim)
        length = np.sqrt((v.astype(float) ** 2).sum(axis=1))
        order = np.argsort(-length, kind="stable")
        self.v, self.length = v[order], length[order]
        self.ids, self.rows = np.frombuffer(ids, dtype=np.int64)[order], np.frombuffer(rows, dtype=np.int64)[order]
        self.unit = self.v / np.maximum(self.length, 1e-300)[:, None]
        self.largest = float(np.abs(v).max(initial=0))
        self.numbers = self.v.astype(float)
        self.sorted: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def coordinate(self, f: int):
        if f not in self.sorted:
            order = np.argsort(self.unit[:, f], kind="stable")
            self.sorted[f] = order, self.unit[order, f]
        return self.sorted[f]

    def candidates(self, q: np.ndarray, q_length: float, least: float) -> np.ndarray:
        """Places in the bucket that may score ``least`` or more."""
        if q_length == 0:
            return np.arange(len(self.ids)) if least <= 0 else np.zeros(0, dtype=np.int64)
        needed = least / q_length
        needed -= abs(needed) * 1e-9 + 1e-6
        end = int(np.searchsorted(-self.length, -needed, side="right")) if needed > 0 else len(self.ids)  # length pruning
        if not end:
            return np.zeros(0, dtype=np.int64)
        cosine = needed / max(self.length[0], 1e-300)
        if cosine < STEEP:
            return np.arange(end)
        cosine = min(cosine - 1e-9, 1.0)
        best = None
        unit = q / q_length
        for f in np.argsort(-np.abs(unit))[:FOCUS]:
            c = min(1.0, max(-1.0, float(unit[f])))
            away = np.sqrt((1 - c * c) * (1 - cosine * cosine))
            low = c * cosine - away if c > -cosine else -1.0
            high = c * cosine + away if c < cosine else 1.0
            order, values = self.coordinate(int(f))
            inside = order[np.searchsorted(values, low - 1e-9) : np.searchsorted(values, high + 1e-9, side="right")]
            inside = inside[inside < end]
            best = inside if best is None else np.intersect1d(best, inside, assume_unique=True)
        return best

    def top(self, q: np.ndarray, q_row: int, least: float, k: int):
        at = self.candidates(q, float(np.sqrt((q.astype(float) ** 2).sum())), least)
        at = at[self.rows[at] != q_row]
        most = float(np.abs(q).max(initial=0)) * self.largest * len(q)
        if most < 2**53:
            whole = q.astype(float)
            scores = (self.numbers[at] @ whole).astype(np.int64) if len(at) < len(self.ids) // 2 else (self.numbers @ whole).astype(np.int64)[at]
        elif most < 2**62:
            scores = self.v[at] @ q
        else:
            exact = self.v[at].astype(object) @ q.astype(object)
            scores = np.array([min(max(x, -MOST), MOST) for x in exact], dtype=np.int64)
        keep = np.flatnonzero(scores >= least)
        keep = keep[np.lexsort((self.ids[at[keep]], -scores[keep]))[:k]]
        return self.ids[at[keep]], self.rows[at[keep]], scores[keep]


def _meet(pairs: DataFrame, k: int) -> DataFrame:
    """The k best of every query of a block in a bucket: columns q_* with floors, and b_*."""
    schema = pa.schema([("q_block", pa.int64()), ("query_row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("cand_row", pa.int64()), ("score", pa.int64())])

    def run(batches):
        for batch in batches:
            for x in batch.to_pylist():
                bucket = Bucket(x["dim"], x["b_ids"], x["b_rows"], x["b_vectors"])
                q = np.frombuffer(x["q_vectors"], dtype=np.int64).reshape(-1, x["dim"])
                q_ids, q_rows = np.frombuffer(x["q_ids"], dtype=np.int64), np.frombuffer(x["q_rows"], dtype=np.int64)
                floors = dict(x["floors"] or [])
                out = []
                for j in range(len(q)):
                    ids, rows, scores = bucket.top(q[j], q_rows[j], floors.get(int(q_rows[j]), -np.inf), k)
                    out.append((np.full(len(ids), x["q_block"]), np.full(len(ids), q_rows[j]), np.full(len(ids), q_ids[j]), ids, rows, scores))
                yield arrow_batch(schema, [np.concatenate(c) for c in zip(*out, strict=True)])

    names = ["dim", "floors", "q_block", *[f"{s}_{c}" for s in "qb" for c in ("ids", "rows", "vectors")]]
    return pairs.select(*names).mapInArrow(run, FOUND)


def top_k(rows: DataFrame, query_rule: str = "vec_id % 50 = 0", k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row its k highest inner products with all other rows."""
    vectors = cut_lineage(scaled(rows, id_col, vec_col))
    side = lambda df, s: df.select("dim", F.col("block").alias(f"{s}_block"), F.col("longest").alias(f"{s}_longest"), *[F.col(c).alias(f"{s}_{c}") for c in ("ids", "rows", "vectors")])
    buckets, queries = side(blocks(vectors, BUCKET), "b"), side(blocks(vectors.where(query_rule), QUERIES), "q")
    longest = buckets.groupBy("dim").agg(F.max_by("b_block", "b_longest").alias("b_block"))
    first = _meet(queries.join(buckets.join(longest, ["dim", "b_block"]), "dim").withColumn("floors", F.lit(None).cast("map<bigint,bigint>")), k)
    # the k-th score of that meeting is the floor of a query; a query that found fewer has none
    floors = cut_lineage(first.groupBy("q_block", "query_row").agg(F.min("score").alias("floor"), F.count("*").alias("n")).where(F.col("n") >= k))
    per = floors.groupBy("q_block").agg(F.map_from_entries(F.collect_list(F.struct("query_row", "floor"))).alias("floors"), F.min("floor").alias("lowest"), F.count("*").alias("n"))
    ready = cut_lineage(queries.join(per, "q_block", "left"))
    # a bucket is too short for a block if even its longest query doesn't reach the block's lowest floor there
    full = (F.col("n") == F.octet_length("q_rows") / 8) & (F.col("lowest") > 0)
    reach = F.col("q_longest") * F.col("b_longest") * (1 + 1e-9) + 1 >= F.when(full, F.col("lowest")).otherwise(F.lit(float("-inf")))
    plan = ready.select("dim", "q_block", "q_longest", "lowest", "n", "q_rows").join(buckets.select("dim", "b_block", "b_longest"), "dim").where(reach).select("q_block", "b_block")
    found = _meet(plan.join(ready, "q_block").join(buckets.drop("dim"), "b_block"), k)
    best = W.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id", "cand_row")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")

