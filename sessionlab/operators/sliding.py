"""Medians of strongly overlapping row windows without a copy of each row per window.

Sessions are cut into chunks of rows, each with the rows that its last windows reach into, so a row travels at most twice. A task takes its chunks one
after another from one sorted stream and keeps the current window as a sorted run: the rows that leave are found in it by rank and those that
arrive are merged in, step rows at a time.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .windows import with_rank

CHUNK_ROWS = 100_000


def run_medians(x: np.ndarray, held: np.ndarray, size: int, step: int) -> np.ndarray:
    """Medians of the held values of rows [w * step, w * step + size), NaN where none is held."""
    count = max(0, (len(x) - size) // step + 1)
    out = np.full(count, np.nan)

    def run(a, b):
        return np.sort(x[a:b][held[a:b]])

    window = run(0, size)
    for w in range(count):
        if w and step < size:
            a = (w - 1) * step
            gone, new = run(a, a + step), run(a + size, a + size + step)
            # equal values leave one after another, so each takes its own place
            at = np.searchsorted(window, gone) + np.arange(len(gone)) - np.searchsorted(gone, gone)
            window = np.delete(window, at)
            window = np.insert(window, np.searchsorted(window, new), new)
        elif w:
            window = run(w * step, w * step + size)
        n = len(window)
        if n:
            out[w] = window[n // 2] if n % 2 else 0.5 * window[n // 2 - 1] + 0.5 * window[n // 2]
    return out


def sliding_medians(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str], size: int, step: int, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """(keys..., window_id, start, <col>_median...) of the complete windows of ``size`` rows every ``step`` rows.

    Nulls are left out, a window without values has a null median; sessions shorter than a window have none. Rows whose keys are null
    belong to no session.
    """
    keys, cols = list(keys), list(cols)
    width = step * -(-max(size, chunk_rows) // step)
    r = with_rank(df.select(*dict.fromkeys([*keys, *order, *cols])), keys, order)
    rn = F.col("rn")
    first = F.greatest(F.lit(0), F.ceil((rn - (width - step + size - 1)) / F.lit(width)))
    r = r.select(
        *keys, F.explode(F.sequence(first.cast("long"), F.floor(rn / F.lit(width)).cast("long"))).alias("_k"), rn.cast("long").alias("_rn"),
        F.col(order[0]).alias("start"), *[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(cols)],
    )
    rows = r.repartition(*keys, "_k").sortWithinPartitions(*keys, "_k", "_rn")
    schema = r.select(*keys, F.col("_k").alias("window_id"), "start", *[F.col(f"_v{i}").alias(f"{c}_median") for i, c in enumerate(cols)]).schema
    names = [f.name for f in schema]

    def one(parts):
        t = pa.Table.from_batches(parts)
        base, n = t.column("_rn")[0].as_py(), t.num_rows
        count = min(max(0, (n - size) // step + 1), width // step)
        if not count:
            return None
        at = pa.array(np.arange(count) * step)
        end = (count - 1) * step + size
        medians = []
        for i in range(len(cols)):
            v = t.column(f"_v{i}").combine_chunks()
            x, held = v.fill_null(0.0).to_numpy(zero_copy_only=False), v.is_valid().to_numpy(zero_copy_only=False)
            m = run_medians(x[:end], held[:end], size, step)
            some = np.concatenate([[0], np.cumsum(held[:end])])
            filled = some[np.arange(count) * step + size] > some[np.arange(count) * step]
            medians.append(pa.array(m, pa.float64(), mask=~filled))
        fixed = [t.column(k).take(at).combine_chunks() for k in keys]
        ids = pa.array((base // step) + np.arange(count), pa.int64())
        return pa.table([*fixed, ids, t.column("start").take(at).combine_chunks(), *medians], names)

    def run(batches):
        held = []
        for batch in batches:
            # a chunk's first row, and no other row of it, has the place where the chunk begins
            cuts = np.flatnonzero(batch.column("_rn").to_numpy() == batch.column("_k").to_numpy() * width)
            done = []
            if len(cuts):
                if cuts[0]:
                    held.append(batch.slice(0, cuts[0]))
                done = [held, *[[batch.slice(a, b - a)] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]]
                held = [batch.slice(cuts[-1])]
            else:
                held.append(batch)
            ready = [t for t in (one(parts) for parts in done if parts) if t is not None]
            if ready:
                yield from pa.concat_tables(ready).to_batches()
        last = one(held) if held else None
        if last is not None:
            yield from last.to_batches()

    return rows.mapInArrow(run, schema)
