"""Ordered scans that stay parallel inside one session.

A plain ``Window.partitionBy(session)`` puts a whole session into one task, however long it
is.  Here every session is cut into chunks of bounded size along its order column; windows run
inside a chunk, one small summary row per chunk carries state across the cuts, and the
result equals the unchunked window exactly.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_CHUNK = 2_000_000
SAMPLES = 32
GRID_BLOCK = 4096

CHUNK = "_chunk"
_RN = "_rn"
_LONG = "_long"


def with_chunk(
    df: DataFrame, keys: Sequence[str], order: str | Sequence[str], rows_per_chunk: int | None = None, name: str = CHUNK, long_flag: str | None = None
) -> DataFrame:
    """Add a chunk number per row: about ``rows_per_chunk`` rows each, monotone in ``order``.

    One aggregate per session counts its rows and keeps those whose order columns hash below a fixed share, about SAMPLES a
    chunk. In sessions of more than one chunk every SAMPLES-th of them, sorted, is a cut, so chunks follow
    the rows, not the clock: a stray stamp or a burst costs nothing, and rows of one stamp are split by the other order columns.
    Which rows are drawn decides only where chunks end, never the result. There is one cut for about
    ``rows_per_chunk`` rows; the data itself is not shuffled here. ``long_flag`` names an extra column
    that marks the rows of sessions with cuts.
    """
    limit = rows_per_chunk or ROWS_PER_CHUNK
    order = [order] if isinstance(order, str) else list(order)
    share = min(1.0, SAMPLES / limit)
    step = max(1, round(share * limit))
    at = F.struct(*order)
    drawn = F.xxhash64(*order) <= F.lit(min(2**63 - 1, int(-(2**63) + share * 2**64)))
    stats = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.sort_array(F.collect_list(F.when(drawn, at))).alias("_drawn"))
    cuts = F.filter("_drawn", lambda c, i: (i > 0) & (i % step == 0))
    long = stats.where(F.col("_n") > limit).select(*keys, cuts.alias("_cuts")).where(F.size("_cuts") > 0)
    passed = F.size(F.filter("_cuts", lambda c: c <= at))
    out = df.join(F.broadcast(long), list(keys), "left").withColumn(name, F.when(F.col("_cuts").isNotNull(), passed).otherwise(0).cast("long"))
    if long_flag:
        out = out.withColumn(long_flag, F.col("_cuts").isNotNull())
    return out.drop("_cuts")


def measure(df: DataFrame, keys: Sequence[str], order: str, name: str) -> DataFrame:
    """Chunk column ``name`` (and its ``<name>_long`` flag) for ``scan(..., premeasured=name)``."""
    return with_chunk(df, keys, order, name=name, long_flag=f"{name}_long")


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    exprs: Mapping[str, tuple],
    *,
    chunk: Column | None = None,
    rows_per_chunk: int | None = None,
    premeasured: str | None = None,
) -> DataFrame:
    """Add running columns to ``df``, evaluated per ``keys`` in ascending ``order``.

    ``exprs`` maps an output name to one of ``("rank",)``, ``("cumsum", col)``,
    ``("last", col)`` (latest non-null up to this row), ``("before", col)`` (strictly earlier),
    ``("next", col)`` (first non-null from this row on), ``("after", col)`` (strictly later).
    ``col`` may be a name or a Column; wrap it in a struct to treat nulls as values.
    ``chunk`` replaces the measured chunks by an expression monotone in ``order[0]``.
    ``premeasured`` names a column made by ``measure`` so that several scans share one chunking.
    Rows whose keys are null belong to no session and are left out.
    """
    keys, order = list(keys), list(order)
    df = df.dropna(subset=keys)
    measured = chunk is None
    if premeasured:
        base = df.withColumns({CHUNK: F.col(premeasured), _LONG: F.col(f"{premeasured}_long")})
    elif measured:
        base = with_chunk(df, keys, order, rows_per_chunk, long_flag=_LONG)
    else:
        base = df.withColumn(CHUNK, chunk.cast("long"))
    group = [*keys, CHUNK]
    asc = Window.partitionBy(*group).orderBy(*[F.col(c).asc() for c in order])
    desc = Window.partitionBy(*group).orderBy(*[F.col(c).desc() for c in order])
    upto = (Window.unboundedPreceding, Window.currentRow)
    past = (Window.unboundedPreceding, -1)

    def val(spec):
        return F.col(spec[1]) if isinstance(spec[1], str) else spec[1]

    sources = {name: f"_v{i}" for i, name in enumerate(exprs)}
    base = base.withColumns({sources[n]: val(s) for n, s in exprs.items() if len(s) > 1})
    local, summary, carry = {}, {}, {}
    back = Window.partitionBy(*keys).orderBy(F.col(CHUNK).asc()).rowsBetween(*past)
    fore = Window.partitionBy(*keys).orderBy(F.col(CHUNK).desc()).rowsBetween(*past)
    for name, spec in exprs.items():
        kind, src, tmp = spec[0], sources[name], f"_s{sources[name]}"
        if kind == "rank":
            summary[tmp] = F.count(F.lit(1))
            carry[tmp] = F.sum(tmp).over(back)
        elif kind == "cumsum":
            local[name] = F.sum(src).over(asc.rowsBetween(*upto))
            summary[tmp] = F.sum(src)
            carry[tmp] = F.sum(tmp).over(back)
        elif kind in ("last", "before"):
            local[name] = F.last(src, ignorenulls=True).over(asc.rowsBetween(*(upto if kind == "last" else past)))
            summary[tmp] = F.max_by(src, F.when(F.col(src).isNotNull(), F.col(_RN)))
            carry[tmp] = F.last(tmp, ignorenulls=True).over(back)
        elif kind in ("next", "after"):
            local[name] = F.last(src, ignorenulls=True).over(desc.rowsBetween(*(upto if kind == "next" else past)))
            summary[tmp] = F.min_by(src, F.when(F.col(src).isNotNull(), F.col(_RN)))
            carry[tmp] = F.last(tmp, ignorenulls=True).over(fore)
        else:
            raise ValueError(f"unknown running expression: {kind}")
    placed = base.withColumns({_RN: F.row_number().over(asc), **local})
    # only sessions of several chunks carry state; the filter sits below the summary's shuffle
    source = (base.where(F.col(_LONG)) if measured else base).withColumn(_RN, F.row_number().over(asc))
    carried = source.groupBy(*group).agg(*[c.alias(n) for n, c in summary.items()]).select(
        *group, *[c.alias(n) for n, c in carry.items()]
    )
    # the rows are already partitioned and sorted by these keys, so either join strategy leaves them in place
    out = placed.join(carried, group, "left")
    final = []
    for name, spec in exprs.items():
        tmp = F.col(f"_s{sources[name]}")
        if spec[0] == "rank":
            final.append((F.col(_RN) + F.coalesce(tmp, F.lit(0))).cast("long").alias(name))
        elif spec[0] == "cumsum":
            final.append(
                F.when(F.col(name).isNull() & tmp.isNull(), F.lit(None))
                .otherwise(F.coalesce(F.col(name), F.lit(0)) + F.coalesce(tmp, F.lit(0)))
                .alias(name)
            )
        else:
            final.append(F.coalesce(F.col(name), tmp).alias(name))
    kept = [F.col(c) for c in df.columns if c not in exprs]
    return out.select(*kept, *final)


def steps(df: DataFrame, keys: Sequence[str], order: str, name: str = "step", **kw) -> DataFrame:
    """Difference to the previous row of the session; null on the first row."""
    out = scan(df, keys, [order], {"_prev": ("before", order)}, **kw)
    return out.withColumn(name, F.col(order) - F.col("_prev")).drop("_prev")


def explode_range(df: DataFrame, lo: Column, hi: Column, name: str) -> DataFrame:
    """One row per integer in ``[lo, hi]``, built in two steps so no array exceeds one block."""
    block = F.lit(GRID_BLOCK)
    out = df.withColumns({"__lo": lo.cast("long"), "__hi": hi.cast("long")}).where("__lo <= __hi")
    out = out.withColumn("__blk", F.explode(F.sequence(F.floor(F.col("__lo") / block), F.floor(F.col("__hi") / block))))
    start = F.greatest(F.col("__lo"), F.col("__blk") * block)
    stop = F.least(F.col("__hi"), F.col("__blk") * block + block - 1)
    return out.withColumn(name, F.explode(F.sequence(start, stop))).drop("__lo", "__hi", "__blk")
