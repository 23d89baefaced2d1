"""Pearson matrices of wide tables with gaps, from masked Gram sums.

For every pair of columns the rows that hold both count. With M the mask of held values and X the values, shifted and 0 where missing, the
products M'M, X'M, (X*X)'M and X'X hold all counts, sums, squares and cross products of all pairs at once. They are sums over rows, so tasks add their own
rows, matrices add up by line, and sums of two tables under the same shift may be added too. Columns are shifted by their means first, which keeps
the subtraction of squares well conditioned.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARTS = ("n", "s", "q", "p")
_SCHEMA = "i int, " + ", ".join(f"{p} array<double>" for p in PARTS)


def column_means(df: DataFrame, cols: Sequence[str]) -> list[float]:
    """Means of the finite values, 0 for columns without any (parameters, one per column)."""
    row = df.agg(*[F.avg(_value(c)).alias(f"m{k}") for k, c in enumerate(cols)]).first()
    return [v or 0.0 for v in row]


def _value(c: str):
    x = F.col(c).cast("double")
    return F.when(F.abs(x) < float("inf"), x)


def _lines(sums: np.ndarray, at: Sequence[int]) -> pa.RecordBatch:
    arrays = [pa.array(at, pa.int32())]
    for part in sums:
        flat = np.ascontiguousarray(part, np.float64)
        arrays.append(pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, flat.shape[1], dtype=np.int32)), pa.array(flat.ravel())))
    return pa.RecordBatch.from_arrays(arrays, ["i", *PARTS])


def masked_sums(df: DataFrame, cols: Sequence[str], shift: Sequence[float], tasks: int | None = None) -> DataFrame:
    """(i, n, s, q, p): line i of the four matrices, n[j] rows with both, s[j] and q[j] sums of column i and its squares over them, p[j] products.

    A task sends one line per column, however many rows it read; lines of one column meet in one task and add up as they come.
    Null, NaN and infinite values are gaps. An empty table gives no lines.
    """
    width, centre = len(cols), np.asarray(shift)

    def add(batches):
        total = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(width)], axis=1) - centre
            held = ~np.isnan(x)
            x[~held] = 0.0
            m = held.astype(np.float64)
            now = np.stack([m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x])
            total = now if total is None else total + now
        if total is not None:
            for k in range(0, width, 64):
                yield _lines(total[:, k : k + 64], range(k, min(k + 64, width)))

    def merge(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            parts = np.stack([batch.column(k).flatten().to_numpy().reshape(-1, width) for k in range(1, 5)], axis=1)
            for i, line in zip(batch.column(0).to_pylist(), parts, strict=True):
                sums[i] = line + sums[i] if i in sums else line.copy()
        if sums:
            yield _lines(np.stack(list(sums.values()), axis=1), list(sums))

    partial = df.select(*[_value(c).alias(f"c{k}") for k, c in enumerate(cols)]).mapInArrow(add, _SCHEMA)
    dealt = partial.repartition(tasks, "i") if tasks else partial.repartition("i")
    return dealt.mapInArrow(merge, _SCHEMA)


def correlations(sums: DataFrame, cols: Sequence[str], decimals: int | None = 3) -> DataFrame:
    """(a, b, r) of the lower triangle; null where fewer than two rows hold both or one of the columns is constant on them.

    Line i has sums of column i over the rows that hold j; those of j come from line j, so lines are turned into pairs and joined with themselves
    turned round: columns squared in rows, whatever the table's length.
    """
    cell = F.posexplode(F.arrays_zip(*PARTS)).alias("j", "v")
    flat = sums.select("i", cell).select("i", "j", "v.*")
    lower = flat.where("j < i")
    upper = flat.where("j > i").select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("s").alias("t"), F.col("q").alias("u"))
    names = F.array(*[F.lit(c) for c in cols])

    def spread(s, q):
        d = F.col(q) - F.col(s) * F.col(s) / F.col("n")
        return F.when(d > F.col(q) * 1e-13, d)

    r = (F.col("p") - F.col("s") * F.col("t") / F.col("n")) / F.sqrt(spread("s", "q") * spread("t", "u"))
    r = F.when((F.col("n") >= 2) & r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))
    out = lower.join(upper, ["i", "j"])
    return out.select(names[F.col("i")].alias("a"), names[F.col("j")].alias("b"), (r if decimals is None else F.round(r, decimals)).alias("r"))


def corr_matrix_wide(df: DataFrame, cols: Sequence[str], decimals: int | None = 3) -> DataFrame:
    """Pairwise complete Pearson correlations of many columns in two scans."""
    return correlations(masked_sums(df, cols, column_means(df, cols)), cols, decimals)
