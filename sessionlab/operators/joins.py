"""Joins over sessions: nearest as-of, outer fusion, interval labels, folds, pairing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small
from .ordered import explode_range, scan


def time_chunk(col: str, width: float | None):
    """Fixed-width chunks for streams of a known top rate; None lets the scan measure the data."""
    return None if width is None else F.floor(F.col(col) / F.lit(float(width)))


def fuse_sensors_asof(
    base: DataFrame,
    others: Sequence[tuple[DataFrame, Sequence[str]]],
    by: Sequence[str],
    on: str,
    tolerance: float,
    chunk_width: float | None = None,
) -> DataFrame:
    """Attach the nearest row of every other stream to the base stream.

    One union and one ordered scan serve all streams.  Inclusive tolerance; a tie goes to the
    earlier row; a right row may serve many left rows; unmatched left rows stay with nulls.
    """
    by = list(by)
    left_cols = [c for c in base.columns if c not in (*by, on)]
    side = base.select(*by, F.col(on).alias("_t"), F.lit(1).alias("_side"), F.struct(F.lit(0).alias("_x"), *left_cols).alias("_l"))
    exprs = {}
    for i, (df, cols) in enumerate(others):
        rec = F.struct(F.col(on).cast("double").alias("t"), *[F.col(c) for c in cols])
        side = side.unionByName(
            df.select(*by, F.col(on).alias("_t"), F.lit(0).alias("_side"), rec.alias(f"_r{i}")), allowMissingColumns=True
        )
        exprs[f"_p{i}"] = ("last", f"_r{i}")
        exprs[f"_n{i}"] = ("after", f"_r{i}")
    seen = scan(side, by, ["_t", "_side"], exprs, chunk=time_chunk("_t", chunk_width)).where("_side = 1")
    out = [*[F.col(k) for k in by], F.col("_t").alias(on), *[F.col(f"_l.{c}").alias(c) for c in left_cols]]
    for i, (_, cols) in enumerate(others):
        back, fore = F.col("_t") - F.col(f"_p{i}.t"), F.col(f"_n{i}.t") - F.col("_t")
        use_back = (back <= tolerance) & (fore.isNull() | (back <= fore))
        use_fore = (fore <= tolerance) & (back.isNull() | (fore < back))
        for c in cols:
            out.append(F.when(use_back, F.col(f"_p{i}.{c}")).when(use_fore, F.col(f"_n{i}.{c}")).alias(c))
    return seen.select(*out)


def asof_nearest(
    left: DataFrame, right: DataFrame, on: str, by: Sequence[str], tolerance: float, cols: Sequence[str], chunk_width: float | None = None
) -> DataFrame:
    """Left-preserving nearest as-of join within an inclusive tolerance."""
    return fuse_sensors_asof(left, [(right, cols)], by, on, tolerance, chunk_width)


def fuse_sensors_outer(streams: Sequence[DataFrame], by: Sequence[str], on: str) -> DataFrame:
    """Union of all stamps, null where a sensor has no sample: one union and one hash aggregate."""
    out = streams[0]
    for s in streams[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    cols = [c for c in out.columns if c not in (*by, on)]
    return out.groupBy(*by, on).agg(*[F.max(c).alias(c) for c in cols])


def join_dim(df: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Left join of a dimension, broadcast only when its size estimate allows."""
    return df.join(broadcast_if_small(dim), key, "left")


def interval_events(intervals: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, _t, _side, _iv): from each event on, ``_iv`` (o, e, l) is the open interval of its label that is latest in list order.

    Side 0 takes effect at its stamp, side 2 right after it. Intervals of a label normally follow one another and give one event
    each; only labels of sessions whose intervals overlap are paired with themselves to find what is open at each start and end.
    """
    by = [*by, "label"]
    rec = F.struct(F.col("ord").alias("o"), F.col("end").cast("double").alias("e"), F.col("label").alias("l"))
    own = intervals.select(*by, F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), rec.alias("_iv"))
    reach = F.max("end").over(Window.partitionBy(*by).orderBy("start", "_iv").rowsBetween(Window.unboundedPreceding, -1))
    tangled = own.withColumn("_reach", reach).where(F.col("start") <= F.col("_reach")).select(*by).distinct()
    plain = own.join(tangled, by, "left_anti").select(*by, F.col("start").alias("_t"), F.lit(0).alias("_side"), "_iv")
    several = own.join(tangled, by, "left_semi")
    moments = several.select(*by, F.explode(F.array(F.struct(F.col("start").alias("_t"), F.lit(0).alias("_side")), F.struct(F.col("end").alias("_t"), F.lit(2).alias("_side")))).alias("m")).select(*by, "m.*").distinct()
    still = F.when(F.col("_side") == 0, F.col("end") >= F.col("_t")).otherwise(F.col("end") > F.col("_t"))
    opened = moments.join(several, by).where((F.col("start") <= F.col("_t")) & still).groupBy(*by, "_t", "_side").agg(F.max("_iv").alias("_iv"))
    return plain.unionByName(opened).drop("label")


def label_rows(
    rows: DataFrame,
    intervals: DataFrame,
    labels: Sequence[str],
    by: Sequence[str],
    time: str,
    which: str = "last",
    outside: str = "label",
    chunk_width: float | None = None,
) -> DataFrame:
    """Label every row from its session's intervals (inclusive bounds).

    The interval latest in list order wins on overlap; the open gap between activity and
    fatigue becomes ``pre_fatigue``; other rows between first start and last end are
    ``unlabeled``; rows outside that range, and sessions without intervals, are dropped.
    ``which`` picks the last or first activity end and fatigue start for the gap.
    ``outside='drop'`` keeps only rows inside an interval.  One running value per label holds its
    open interval (``interval_events``): no interval list is gathered and none is broadcast.
    """
    by = list(by)
    pick = F.max_by if which == "last" else F.min_by

    def edge(col, label):
        return pick(col, F.when(F.col("label") == label, F.col("ord")))

    span = intervals.groupBy(*by).agg(
        F.min("start").alias("_first"), F.max("end").alias("_last"),
        edge("end", "activity").alias("_ae"), edge("start", "fatigue").alias("_fs"),
    )
    r = rows.select(*by, F.col(time).cast("double").alias("_t"), F.lit(1).alias("_side"), F.struct(F.lit(0).alias("_x"), *[c for c in rows.columns if c not in (*by, time)]).alias("_row"))
    i = interval_events(intervals, by)
    both = r.unionByName(i, allowMissingColumns=True).withColumn("_io", F.coalesce(F.col("_iv.o"), F.lit(0)))
    exprs = {f"_c{n}": ("last", F.when(F.col("_iv.l") == l, F.col("_iv"))) for n, l in enumerate(labels)}
    seen = scan(both, by, ["_t", "_side", "_io"], exprs, chunk=time_chunk("_t", chunk_width)).where("_side = 1")
    live = [F.when(F.col("_t") <= F.col(f"_c{n}.e"), F.col(f"_c{n}")) for n in range(len(labels))]
    best = F.array_max(F.array_compact(F.array(*live)))["l"] if len(live) > 1 else live[0]["l"]
    out = seen.withColumn("label", best).join(broadcast_if_small(span), by)
    out = out.where((F.col("_t") >= F.col("_first")) & (F.col("_t") <= F.col("_last")))
    if outside == "drop":
        out = out.where(F.col("label").isNotNull())
    gap = (F.col("_t") > F.col("_ae")) & (F.col("_t") < F.col("_fs"))
    label = F.coalesce(F.col("label"), F.when(gap, F.lit("pre_fatigue")), F.lit("unlabeled"))
    kept = [F.col(f"_row.{c}").alias(c) for c in rows.columns if c not in (*by, time)]
    return out.select(*by, F.col("_t").alias(time), *kept, label.alias("label"))


def label_windows_overlap(
    bounds: DataFrame, intervals: DataFrame, by: Sequence[str], lo: str, hi: str, size: float, step: float
) -> DataFrame:
    """Label of every full time window: the interval with the largest positive overlap, first on ties.

    An interval knows by arithmetic which windows it touches, so it explodes straight to window
    ids; a chain of runs over a long session spreads over (session, window).
    """
    i = intervals.join(bounds.select(*by, lo, hi), list(by))
    rel_s, rel_e = F.col("start") - F.col(lo), F.col("end") - F.col(lo)
    first = F.greatest(F.lit(0), F.floor((rel_s - size) / step))
    last = F.least(F.ceil(rel_e / step), F.floor((F.col(hi) - F.col(lo) - size) / step))
    w = explode_range(i, first, last, "window_id")
    ws = F.col(lo) + F.col("window_id") * F.lit(float(step))
    w = w.withColumns({"_ws": ws, "_ov": F.least(ws + size, F.col("end")) - F.greatest(ws, F.col("start"))}).where("_ov > 0")
    return w.groupBy(*by, "window_id").agg(
        F.min("_ws").alias("start"), F.max_by("label", F.struct("_ov", -F.col("ord"))).alias("label"), F.max("_ov").alias("overlap")
    )


def with_fold_flag(df: DataFrame, test_keys: dict[str, object]) -> DataFrame:
    """Leave-one-session-out split for one fold: adds ``is_test``."""
    cond = F.lit(True)
    for k, v in test_keys.items():
        cond = cond & (F.col(k) == F.lit(v))
    return df.withColumn("is_test", cond)


def by_sessions(df: DataFrame, keys: DataFrame, on: Sequence[str], how: str = "semi") -> DataFrame:
    """Keep (semi) or remove (anti) the rows of a list of sessions."""
    return df.join(broadcast_if_small(keys), list(on), f"left_{how}")


def pair_folds(a: DataFrame, b: DataFrame, on: Sequence[str], score: str) -> DataFrame:
    """Scores of two models side by side with their difference; unmatched folds keep nulls."""
    right = b.select(*on, F.col(score).alias("score_b"))
    out = a.select(*on, F.col(score).alias("score_a")).join(right, list(on), "left")
    return out.withColumn("delta", F.col("score_b") - F.col("score_a"))


def lerp_hourly(df: DataFrame, hourly: DataFrame, time: str, value: str) -> DataFrame:
    """Blend an hourly series linearly inside the hour of each row.

    ``time`` is epoch ms; ``hourly`` has (hour, value) with hour = epoch hours.  Hour rows get their
    successor by one self equi-join on the hour, then rows join on the hour.
    """
    nxt = hourly.select((F.col("hour") - 1).alias("hour"), F.col(value).alias("_v1"))
    pairs = hourly.select("hour", F.col(value).alias("_v0")).join(nxt, "hour")
    r = df.withColumn("hour", F.floor(F.col(time) / 3_600_000.0))
    share = F.col(time) / 3_600_000.0 - F.col("hour")
    return r.join(broadcast_if_small(pairs), "hour").withColumn(
        f"{value}_lerp", F.col("_v0") + (F.col("_v1") - F.col("_v0")) * share
    ).drop("_v0", "_v1")


def align_predictions(grid: DataFrame, preds: Sequence[tuple[str, DataFrame]], on: Sequence[str]) -> DataFrame:
    """Left join every predictor; ``lost`` names the first one that lacks the window, null if all have it."""
    out, reason = grid, F.lit(None).cast("string")
    for name, df in preds:
        out = out.join(df.withColumn(f"_has_{name}", F.lit(True)), list(on), "left")
    for name, _ in reversed(preds):
        reason = F.when(F.col(f"_has_{name}").isNull(), F.lit(f"no_{name}")).otherwise(reason)
    return out.withColumn("lost", reason).drop(*[f"_has_{n}" for n, _ in preds])


def alignment_report(aligned: DataFrame, alert_percent: float = 20.0) -> DataFrame:
    """Windows kept and lost by reason, loss in percent, alert flag."""
    total = aligned.agg(F.count(F.lit(1)).alias("n"), F.count("lost").alias("n_lost"))
    pct = F.col("n_lost") * 100.0 / F.col("n")
    return total.withColumns({"lost_percent": pct, "alert": pct > alert_percent})


def landmark_kernel(vectors: DataFrame, vec: str, landmarks: Sequence[Sequence[float]]) -> DataFrame:
    """Squared inner products with a fixed set of landmark vectors, as an array column.

    The landmark set is a fitted parameter (bounded by the caller), so the work is n x m and no
    pair table of the two sets is built.
    """
    values = []
    for m in landmarks:
        lit = F.array(*[F.lit(float(x)) for x in m])
        dot = F.aggregate(F.zip_with(F.col(vec), lit, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
        values.append(dot * dot)
    return vectors.withColumn("kernel", F.array(*values))
