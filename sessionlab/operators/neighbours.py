"""Exact nearest neighbours inside groups, without emitting all pairs.

Rows of a group are ordered by their distance to one reference vector and cut into blocks of
fixed size, so even a group of identical copies splits evenly.  A first round compares each query
block with its home data block and yields an upper bound on the k-th distance; the triangle
inequality then names the only other blocks that can still improve it.  Tasks hold two blocks
at a time and emit at most k rows per query.  Groups that fit one block are compared whole, many
in one call, without order or rounds.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, cut_lineage
from .ordered import scan

BLOCK_ROWS = 4096
#: Queries compared at a time, and pairs summed at a time.
QUERIES, PAIRS = 256, 1 << 18
#: Block pairs of at most so many pairs of rows are compared side by side, since each call costs the same.
SMALL = 1 << 11


def squared_distance(a, b):
    """Squared Euclidean distance of two array columns, JVM-side."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x)


def as_vector(cols: Sequence[str]):
    return F.array(*[F.col(c).cast("double") for c in cols])


def _close(x: np.ndarray, y: np.ndarray, qid: np.ndarray, nid: np.ndarray, k: int, skip_self: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of y, squared distance) of the k nearest rows of y for every row of x, ranked by distance and nid.

    Wide vectors are first compared by a matrix product; all pairs that its rounding error leaves open are summed term by term.
    """
    width = x.shape[1]
    rough, slack = None, 0.0
    if width > 4:
        nx, ny = (x * x).sum(axis=1), (y * y).sum(axis=1)
        with np.errstate(all="ignore"):
            rough = nx[:, None] + ny - 2.0 * (x @ y.T)
        slack = 8 * (width + 8) * np.finfo(np.float64).eps * (nx + ny.max())
        if not np.isfinite(rough).all():
            rough, slack = None, 0.0
    if rough is None:
        rough = np.zeros((len(x), len(y)))
        for j in range(width):
            rough += (x[:, j : j + 1] - y[:, j]) ** 2
    if skip_self:
        rough[qid[:, None] == nid[None, :]] = np.inf
    if len(y) > k:
        row, col = np.nonzero(~(rough > (np.partition(rough, k - 1, axis=1)[:, k - 1] + slack)[:, None]))
    else:
        row, col = (i.ravel() for i in np.indices(rough.shape))
    d2 = np.empty(len(row))
    for lo in range(0, len(row), PAIRS):
        r, c = row[lo : lo + PAIRS], col[lo : lo + PAIRS]
        part = np.zeros(len(r))
        for j in range(width):
            part += (x[r, j] - y[c, j]) ** 2
        d2[lo : lo + PAIRS] = part
    if skip_self:
        d2[qid[row] == nid[col]] = np.inf
    order = np.lexsort((nid[col], d2, row))
    row, col, d2 = row[order], col[order], d2[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    kept = (rank < k) & np.isfinite(d2)
    return row[kept], col[kept], d2[kept]


def _vectors(rows: pa.ListArray) -> np.ndarray:
    """One line per vector, null components as NaN."""
    sizes = np.diff(rows.offsets.to_numpy())
    if rows.null_count or (sizes != sizes[0]).any():
        raise ValueError("vectors of a group differ in length")
    return rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(rows), -1)


def _first_k(group: np.ndarray, row: np.ndarray, col: np.ndarray, d2: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(row, col, d2, rank) of the k nearest per group and query id, which may stand in several rows; what isn't finite is no neighbour."""
    kept = np.isfinite(d2)
    group, row, col, d2 = group[kept], row[kept], col[kept], d2[kept]
    order = np.lexsort((ids[col], d2, ids[row], group))
    group, row, col, d2 = group[order], row[order], col[order], d2[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (group[1:] != group[:-1]) | (ids[row[1:]] != ids[row[:-1]])
    first = np.flatnonzero(new)
    rank = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row)))) + 1
    kept = rank <= k
    return row[kept], col[kept], d2[kept], rank[kept]


def _small_pairs(a: np.ndarray, cut: np.ndarray, b: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, skip_self: bool):
    """``_first_k`` of block pairs with queries in rows a to cut and data in rows cut to b, all pairs of about PAIRS rows at a time."""
    last = np.cumsum((cut - a) * (b - cut)) // PAIRS
    for lo, hi in zip(np.flatnonzero(np.diff(last, prepend=-1)), [*np.flatnonzero(np.diff(last)) + 1, len(a)], strict=True):
        width = (cut - a)[lo:hi]
        row = np.repeat(a[lo:hi] - np.cumsum(width) + width, width) + np.arange(width.sum())
        group, many = np.repeat(np.arange(lo, hi), width), np.repeat((b - cut)[lo:hi], width)
        col = np.repeat(np.repeat(cut[lo:hi], width) - np.cumsum(many) + many, many) + np.arange(many.sum())
        row, group = np.repeat(row, many), np.repeat(group, many)
        d2 = np.zeros(len(row))
        for j in range(x.shape[1]):
            d2 += (x[row, j] - x[col, j]) ** 2
        if skip_self:
            d2[ids[row] == ids[col]] = np.inf
        yield _first_k(group, row, col, d2, ids, k)


def _compare_in_order(pair: Sequence[str], by: Sequence[str], k: int, skip_self: bool):
    """Task body over rows (pair..., isdata, id, vec) sorted by all but the last two: k best data rows of every query of a block pair, with ``by``.

    A task goes through its block pairs one after another, however small they are, and holds one pair and one batch.
    """
    pair = list(pair)

    def starts(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, dtype=bool)
        new[0] = True
        for c in pair:
            code = table.column(c).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            new[1:] |= code[1:] != code[:-1]
        return np.flatnonzero(new)

    def found(table: pa.Table, first: np.ndarray) -> pa.RecordBatch:
        is_data, ids = table.column("isdata").to_numpy(), table.column("id").to_numpy()
        vec = table.column("vec").combine_chunks()
        data_before = np.append(0, np.cumsum(is_data))
        ends = np.append(first[1:], table.num_rows)
        cuts = ends - (data_before[ends] - data_before[first])  # queries come first
        both = (cuts > first) & (cuts < ends)
        first, cuts, ends = first[both], cuts[both], ends[both]
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))]
        widths = np.unique(np.diff(vec.offsets.to_numpy()))
        small = (cuts - first) * (ends - cuts) <= SMALL if len(widths) == 1 and not vec.null_count else np.zeros(len(first), dtype=bool)
        if small.any():
            out += _small_pairs(first[small], cuts[small], ends[small], _vectors(vec), ids, k, skip_self)
        for a, cut, b in zip(first[~small], cuts[~small], ends[~small], strict=True):
            y, nid = _vectors(vec.slice(cut, b - cut)), ids[cut:b]
            found_here = []
            for lo in range(a, cut, QUERIES):
                hi = min(cut, lo + QUERIES)
                row, col, d2 = _close(_vectors(vec.slice(lo, hi - lo)), y, ids[lo:hi], nid, k, skip_self)
                found_here.append((row + lo, col + cut, d2))
            row, col, d2 = (np.concatenate(c) for c in zip(*found_here))
            out.append(_first_k(np.zeros(len(row), np.int64), row, col, d2, ids, k))
        row, col, d2, rank = (np.concatenate(c) for c in zip(*out))
        keys = [table.column(c).take(pa.array(row)).combine_chunks() for c in by]
        return pa.RecordBatch.from_arrays([*keys, pa.array(ids[row]), pa.array(ids[col]), pa.array(d2), pa.array(rank, pa.int32())], [*by, "qid", "nid", "d2", "rank"])

    def run(batches):
        waiting = None  # rows of the last block pair so far
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if waiting is None else pa.concat_tables([waiting, table]).combine_chunks()
            first = starts(table)
            if first[-1]:
                yield found(table.slice(0, first[-1]), first[:-1])
            waiting = table.slice(first[-1])
        if waiting is not None:
            yield found(waiting, np.zeros(1, dtype=np.int64))

    return run


def nearest(
    data: DataFrame,
    queries: DataFrame,
    by: Sequence[str],
    k: int,
    *,
    skip_self: bool = False,
    block_rows: int | None = None,
) -> DataFrame:
    """(by..., qid, nid, d2, rank): the k nearest data rows of every query in its own group.

    ``data`` has columns by..., nid, vec; ``queries`` has by..., qid, vec.  Ids are longs and
    unique in their group; equal distances rank by nid.  ``skip_self`` leaves out nid = qid.
    """
    by, block_rows = list(by), block_rows or BLOCK_ROWS
    schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in data.select(*by).schema], "qid long, nid long, d2 double, rank int"])
    both = data.select(*by, F.col("nid").alias("id"), "vec", F.lit(1).alias("isdata")).unionByName(
        queries.select(*by, F.col("qid").alias("id"), "vec", F.lit(0).alias("isdata"))
    )
    both = cut_lineage(both.dropna(subset=by))  # groups are measured and then compared
    sizes = both.groupBy(*by).agg(F.sum("isdata").alias("_nd"), F.sum(1 - F.col("isdata")).alias("_nq"))
    large = cut_lineage(sizes.where((F.col("_nd") > block_rows) | (F.col("_nq") > block_rows)).select(*by))
    if large.isEmpty():
        return _nearest_of_small(both, by, k, skip_self, schema)
    far = broadcast_if_small(large)
    by_blocks = _nearest_of_blocks(both.join(far, by, "left_semi"), by, k, skip_self, block_rows, schema)
    return _nearest_of_small(both.join(far, by, "left_anti"), by, k, skip_self, schema).unionByName(by_blocks)


def _nearest_of_small(both: DataFrame, by: list[str], k: int, skip_self: bool, schema: str) -> DataFrame:
    """``nearest`` of rows (by..., id, vec, isdata) whose groups fit one block."""
    ordered = both.repartition(*by).sortWithinPartitions(*by, "isdata")
    return ordered.mapInArrow(_compare_in_order(by, by, k, skip_self), schema)


def _nearest_of_blocks(both: DataFrame, by: list[str], k: int, skip_self: bool, block_rows: int, schema: str) -> DataFrame:
    """``nearest`` of rows (by..., id, vec, isdata) by blocks of their groups."""
    data = both.where("isdata = 1").select(*by, F.col("id").alias("nid"), "vec")
    ref = data.groupBy(*by).agg(F.min_by("vec", "nid").alias("_ref"))
    both = both.join(broadcast_if_small(cut_lineage(ref)), by).withColumn("p", F.sqrt(squared_distance(F.col("vec"), F.col("_ref")))).drop("_ref")
    both = scan(
        both, by, ["p", "id", "isdata"], {"_nd": ("cumsum", "isdata"), "_nq": ("cumsum", (1 - F.col("isdata")))}
    )
    home = F.greatest(F.lit(0), F.floor((F.col("_nd") - 1) / block_rows))
    # several rounds read the blocked rows; writing them once keeps the plan small and survives lost executors
    both = cut_lineage(both.withColumns({"home": home, "qb": F.floor((F.col("_nq") - 1) / block_rows)}))
    d = both.where("isdata = 1").select(*by, F.col("id").alias("nid"), "vec", "p", F.col("home").alias("db"))
    q = both.where("isdata = 0").select(*by, F.col("id").alias("qid"), "vec", "p", "home", "qb")
    dblocks = d.groupBy(*by, "db").agg(F.min("p").alias("dlo"), F.max("p").alias("dhi"))

    def compare(pairs: DataFrame, rows: DataFrame) -> DataFrame:
        """Run the block comparison for (by, home, qb, db) pairs; many small pairs share a task and a batch."""
        pair = [*by, "home", "qb", "db"]
        def fresh(df, *cols):  # both sides come from one table; new attribute ids keep them apart
            return df.select(*[F.col(c).alias(c) for c in pair], *cols, F.col("vec").alias("vec"))

        left = fresh(rows.join(pairs, [*by, "home", "qb"]), F.lit(0).alias("isdata"), F.col("qid").alias("id"))
        right = fresh(d.join(pairs, [*by, "db"]), F.lit(1).alias("isdata"), F.col("nid").alias("id"))
        ordered = left.unionByName(right).repartition(*pair).sortWithinPartitions(*pair, "isdata")
        return ordered.mapInArrow(_compare_in_order(pair, by, k, skip_self), schema)

    own = q.select(*by, "home", "qb").distinct().withColumn("db", F.col("home"))
    first = cut_lineage(compare(own, q))
    bound = first.groupBy(*by, "qid").agg(F.count(F.lit(1)).alias("_m"), F.max("d2").alias("_worst"))
    q2 = q.join(bound, [*by, "qid"], "left").withColumn(
        "r", F.when(F.coalesce("_m", F.lit(0)) >= k, F.sqrt("_worst")).otherwise(F.lit(float("inf")))
    )
    # the bound is widened by rounding error so that pruning never drops an equal distance
    qblocks = q2.groupBy(*by, "home", "qb").agg(
        F.min(F.col("p") - F.col("r") * (1 + 1e-12) - 1e-12).alias("qlo"),
        F.max(F.col("p") + F.col("r") * (1 + 1e-12) + 1e-12).alias("qhi"),
        F.max("r").alias("_rmax"),
    )
    # two tiny tables of block ranges; r = 0 already has k exact copies and needs no other block
    more = qblocks.join(dblocks, by).where(
        (F.col("db") != F.col("home")) & (F.col("_rmax") > 0) & (F.col("dlo") <= F.col("qhi")) & (F.col("dhi") >= F.col("qlo"))
    ).select(*by, "home", "qb", "db")
    second = compare(more, q)
    best = Window.partitionBy(*by, "qid").orderBy("d2", "nid")
    return first.unionByName(second).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
