"""Queries over markers, resampling, windows and signal features (operators W and F)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..constants import BREATHING_BAND_HZ
from ..functions import signal as sg
from ..operators import breathing as br
from ..operators import timeseries as ts
from ..operators import windows as wn
from ..operators.ordered import scan, steps
from ..operators.sliding import sliding_medians
from ..session import cut_lineage
from .bindings import HOUR, KEYS, MARKERS, NULLABLE, SIG, markers, nullable, r6, sensor, sig, sql
from .registry import query

ORDER = ["timestamp", "event_id"]
LABELS = ["activity", "fatigue"]
INTERVALS = """m AS (SELECT participant, session, timestamp, pos, label, CASE WHEN contains(marker, 'start_' || label) THEN 1
   WHEN contains(marker, 'end_' || label) THEN 0 END AS o FROM markers, (SELECT unnest(['activity','fatigue']) AS label)),
 k AS (SELECT *, last_value(CASE WHEN o = 1 THEN pos END IGNORE NULLS) OVER w AS sp,
   last_value(CASE WHEN o = 1 THEN timestamp END IGNORE NULLS) OVER w AS st,
   last_value(CASE WHEN o = 0 THEN pos END IGNORE NULLS) OVER w AS ep FROM m WHERE o IS NOT NULL
   WINDOW w AS (PARTITION BY participant, session, label ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 closed AS (SELECT participant, session, label, st AS s, timestamp AS e, pos AS ord FROM k
   WHERE o = 0 AND sp IS NOT NULL AND (ep IS NULL OR sp > ep)),
 org AS (SELECT participant, session, arg_min(s, ord) AS t0 FROM closed GROUP BY ALL),
 iv AS (SELECT participant, session, s - t0 AS start, e - t0 AS "end", label, ord, t0 FROM closed JOIN org USING (participant, session))"""


def _intervals(spark, d):
    return ts.marker_intervals(markers(spark, d), LABELS, KEYS, "timestamp", "marker", "pos")


def _interval_table(spark, d):
    """Intervals written once for operators that read them several times (tiny next to the signals)."""
    return cut_lineage(_intervals(spark, d))


@query("w01_marker_intervals", sql('SELECT participant, session, start, "end", label, ord, t0 FROM iv', MARKERS, INTERVALS))
def w01(spark, d):
    return _intervals(spark, d)


@query(
    "w02_intervals_by_position",
    sql(
        """WITH n AS (SELECT participant, session, timestamp, split_part(marker, '_', 1) AS kind, split_part(marker, '_', 2) AS label,
 row_number() OVER (PARTITION BY participant, session, marker ORDER BY pos) AS i FROM markers WHERE marker <> 'tick')
SELECT a.participant, a.session, a.label, a.i, a.timestamp AS start, b.timestamp AS "end" FROM n a JOIN n b
 ON a.participant = b.participant AND a.session = b.session AND a.label = b.label AND a.i = b.i AND a.kind = 'start' AND b.kind = 'end'""",
        MARKERS,
    ),
)
def w02(spark, d):
    return ts.marker_intervals_by_position(markers(spark, d), LABELS, KEYS, "timestamp", "marker", "pos")


@query(
    "w03_augment_intervals",
    sql(
        """WITH b AS (SELECT participant, session, arg_max("end", ord) FILTER (label = 'activity') AS ae,
 arg_max(start, ord) FILTER (label = 'fatigue') AS fs, max(ord) AS lo FROM iv GROUP BY ALL)
SELECT participant, session, start, "end", label, ord FROM iv
UNION ALL SELECT participant, session, ae, fs, 'pre_fatigue', lo + 1 FROM b WHERE ae < fs""",
        MARKERS, INTERVALS,
    ),
)
def w03(spark, d):
    return ts.augment_intervals(_intervals(spark, d), KEYS)


GRID = """grid AS (SELECT participant, session, unnest(generate_series(lo, hi)) AS b FROM
 (SELECT participant, session, min(b) AS lo, max(b) AS hi FROM o GROUP BY ALL))"""


@query(
    "w04_resample_mean",
    sql(
        """SELECT participant, session, b * 3600000.0::DOUBLE AS timestamp, round(avg(value), 6) + 0.0::DOUBLE AS value
FROM grid LEFT JOIN o USING (participant, session, b) GROUP BY participant, session, b""",
        SIG, "o AS (SELECT *, CAST(floor(timestamp / 3600000) AS BIGINT) AS b FROM sig)", GRID,
    ),
)
def w04(spark, d):
    out = ts.resample_mean(sig(spark, d), KEYS, "timestamp", ["value"], HOUR)
    return out.withColumn("value", r6("value"))


FFILL = """o AS (SELECT *, timestamp / 3600000 AS h, CAST(floor(timestamp / 3600000) AS BIGINT) AS b FROM sig WHERE event_type = 'click')"""


@query(
    "w05_resample_ffill",
    sql(
        """SELECT g.participant, g.session, g.b * 3600000.0::DOUBLE AS timestamp, o.value AS click_value FROM grid g
 ASOF LEFT JOIN o ON g.participant = o.participant AND g.session = o.session AND g.b >= o.h""",
        SIG, FFILL, GRID,
    ),
)
def w05(spark, d):
    return ts.resample_ffill(sensor(spark, d, "click"), KEYS, "timestamp", ["click_value"], HOUR)


@query(
    "w06_resample_linear_time",
    sql(
        """WITH a AS (SELECT g.participant, g.session, g.b, o.h AS h0, o.value AS v0 FROM grid g
 ASOF LEFT JOIN o ON g.participant = o.participant AND g.session = o.session AND g.b >= o.h),
c AS (SELECT a.*, o.h AS h1, o.value AS v1 FROM a ASOF LEFT JOIN o ON a.participant = o.participant AND a.session = o.session AND a.b < o.h)
SELECT participant, session, b * 3600000.0::DOUBLE AS timestamp,
 round(CASE WHEN h0 IS NULL THEN NULL WHEN h1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (b - h0) / (h1 - h0) END, 6) + 0.0::DOUBLE AS click_value FROM c""",
        SIG, FFILL, GRID,
    ),
)
def w06(spark, d):
    out = ts.resample_linear(sensor(spark, d, "click"), KEYS, "timestamp", ["click_value"], HOUR, mode="time")
    return out.withColumn("click_value", r6("click_value"))


EXACT = """q AS (SELECT participant, session, floor(timestamp / 600000) / 6 AS h, avg(value) AS value FROM sig GROUP BY ALL),
 o AS (SELECT *, CAST(floor(h) AS BIGINT) AS b FROM q), x AS (SELECT * FROM o WHERE h = b)"""


@query(
    "w06_resample_linear_exact",
    sql(
        """WITH a AS (SELECT g.participant, g.session, g.b, x.b AS h0, x.value AS v0 FROM grid g
 ASOF LEFT JOIN x ON g.participant = x.participant AND g.session = x.session AND g.b >= x.b),
c AS (SELECT a.*, x.b AS h1, x.value AS v1 FROM a ASOF LEFT JOIN x ON a.participant = x.participant AND a.session = x.session AND a.b < x.b)
SELECT participant, session, b * 3600000.0::DOUBLE AS timestamp,
 round(CASE WHEN h0 IS NULL THEN NULL WHEN h1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (b - h0) / (h1 - h0) END, 9) + 0.0::DOUBLE AS value FROM c""",
        SIG, EXACT, GRID,
    ),
)
def w06x(spark, d):
    ten = ts.resample_mean(sig(spark, d), KEYS, "timestamp", ["value"], HOUR / 6, gaps=False)
    out = ts.resample_linear(ten, KEYS, "timestamp", ["value"], HOUR, mode="exact")
    return out.withColumn("value", F.round("value", 9))


@query(
    "w07_resample_auto",
    sql(
        """SELECT g.participant, g.session, g.b * 3600000.0::DOUBLE AS timestamp, o.value AS click_value FROM grid g
 ASOF LEFT JOIN o ON g.participant = o.participant AND g.session = o.session AND g.b >= o.h""",
        SIG, FFILL, GRID,
    ),
)
def w07(spark, d):
    # a native rate below 1 Hz picks the forward fill; the target is one sample per hour
    return ts.resample_auto(sensor(spark, d, "click"), KEYS, "timestamp", ["click_value"], 1 / 7200, 1 / 3600)


@query(
    "w08_ffill_bfill",
    sql(
        """WITH f AS (SELECT *, last_value(value IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a,
 first_value(value IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM nul
 WINDOW w AS (PARTITION BY participant, session ORDER BY timestamp, event_id))
SELECT participant, session, timestamp, round(coalesce(a, b, (SELECT quantile_cont(value, 0.5) FROM nul)), 6) AS value, label, event_id, event_type FROM f""",
        NULLABLE,
    ),
)
def w08(spark, d):
    return ts.ffill_bfill(nullable(spark, d), KEYS, ORDER, ["value"]).withColumn("value", r6("value"))


@query(
    "w09_interpolate_limited",
    sql(
        """WITH r AS (SELECT *, row_number() OVER (PARTITION BY participant, session ORDER BY timestamp, event_id) AS r FROM sig),
 n AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN value END AS v FROM r),
 f AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN r END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pr,
 last_value(v IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pv,
 first_value(CASE WHEN v IS NOT NULL THEN r END IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nr,
 first_value(v IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv FROM n
 WINDOW w AS (PARTITION BY participant, session ORDER BY r))
SELECT participant, session, event_id, timestamp, CAST(v IS NULL AS DOUBLE) AS value_missing,
 round(CASE WHEN v IS NOT NULL THEN v WHEN pr IS NULL THEN nv WHEN nr IS NULL THEN pv
  WHEN r - pr <= 2 OR nr - r <= 2 THEN pv + (nv - pv) * (r - pr) / (nr - pr) ELSE pv + (nv - pv) * 2 / (nr - pr) END, 6) + 0.0::DOUBLE AS value FROM f""",
        SIG,
    ),
)
def w09(spark, d):
    sparse = sig(spark, d).select(*KEYS, "event_id", "timestamp", F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("value"))
    return ts.interpolate_limited(sparse, KEYS, "timestamp", "value", limit=2).withColumn("value", r6("value"))


@query(
    "w10_positive_steps",
    sql(
        """WITH s AS (SELECT participant, session, event_id, timestamp - lag(timestamp) OVER (PARTITION BY participant, session ORDER BY timestamp) AS step FROM sig)
SELECT * FROM s WHERE step > 0""",
        SIG,
    ),
)
def w10(spark, d):
    return ts.positive_steps(sig(spark, d).select(*KEYS, "event_id", "timestamp"), KEYS, "timestamp").drop("timestamp")


ROWS = """r AS (SELECT *, row_number() OVER (PARTITION BY participant, session ORDER BY timestamp, event_id) - 1 AS rn FROM sig),
 c AS (SELECT participant, session, count(*) AS n FROM sig GROUP BY ALL)"""


def _wins(size: int, step: int) -> str:
    return f"""win AS (SELECT r.*, g.k AS window_id FROM r JOIN (SELECT participant, session, unnest(generate_series(0, (n - {size}) // {step})) AS k
 FROM c WHERE n >= {size}) g ON r.participant = g.participant AND r.session = g.session AND r.rn >= g.k * {step} AND r.rn < g.k * {step} + {size})"""


@query(
    "w11_row_windows",
    sql(
        """SELECT participant, session, window_id, min(timestamp) AS start, max(timestamp) AS "end", count(*) AS n
FROM win GROUP BY participant, session, window_id""",
        SIG, ROWS, _wins(8, 4),
    ),
)
def w11(spark, d):
    w = wn.row_windows(sig(spark, d), KEYS, ORDER, 8, 4)
    out = w.groupBy(*KEYS, "window_id").agg(F.min("timestamp").alias("start"), F.max("timestamp").alias("end"), F.count(F.lit(1)).alias("n"))
    return out.where("n = 8")


@query(
    "w12_adaptive_windows",
    sql(
        """WITH s AS (SELECT *, CASE WHEN participant = 3 THEN 12 ELSE 8 END AS w, CASE WHEN participant = 3 THEN 6 ELSE 4 END AS st FROM c),
 g AS (SELECT *, unnest(generate_series(0, (n - w) // st)) AS k FROM s WHERE n >= w)
SELECT g.participant, g.session, g.k AS window_id, min(timestamp) AS start, max(timestamp) AS "end", round(avg(value), 6) AS value_mean FROM g JOIN r
 ON r.participant = g.participant AND r.session = g.session AND r.rn >= k * st AND r.rn < k * st + w GROUP BY ALL""",
        SIG, ROWS,
    ),
)
def w12(spark, d):
    size, step = wn.adaptive({"default": (8, 4), "3": (12, 6)}, "participant")
    out = wn.window_stats(sig(spark, d), KEYS, ORDER, ["value"], size, step, stats=["mean"])
    return out.withColumn("value_mean", r6("value_mean"))


def _bounds(df):
    return df.groupBy(*KEYS).agg(F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"))


BOUNDS = "bounds AS (SELECT participant, session, min(timestamp) AS lo, max(timestamp) AS hi FROM sig GROUP BY ALL)"
TWIN = """tw AS (SELECT participant, session, lo, k AS window_id, lo + k * 86400000.0 AS start, lo + k * 86400000.0 + 172800000.0 AS "end" FROM
 (SELECT *, unnest(generate_series(0, CAST(floor((hi - lo - 172800000) / 86400000) AS BIGINT))) AS k FROM bounds WHERE hi - lo >= 172800000))"""


@query(
    "w13_time_windows",
    sql('SELECT participant, session, window_id, CAST(start AS DOUBLE) AS start, CAST("end" AS DOUBLE) AS "end" FROM tw', SIG, BOUNDS, TWIN),
)
def w13(spark, d):
    return wn.time_windows(_bounds(sig(spark, d)), KEYS, "lo", "hi", 48 * HOUR, 24 * HOUR)


@query(
    "w14_window_stats",
    sql(
        """WITH l AS (SELECT participant, session, window_id, label, row_number() OVER (PARTITION BY participant, session, window_id ORDER BY count(*) DESC, label) AS k
 FROM win GROUP BY participant, session, window_id, label)
SELECT w.participant, w.session, w.window_id, round(avg(value), 6) AS value_mean, round(stddev_pop(value), 6) AS value_std, min(value) AS value_min,
 max(value) AS value_max, round(median(value), 6) AS value_median, min(timestamp) AS start, max(timestamp) AS "end", any_value(l.label) AS label
FROM win w JOIN l ON w.participant = l.participant AND w.session = l.session AND w.window_id = l.window_id AND l.k = 1 GROUP BY ALL""",
        SIG, ROWS, _wins(8, 4),
    ),
)
def w14(spark, d):
    out = wn.window_stats(sig(spark, d), KEYS, ORDER, ["value"], 8, 4, label="label")
    return out.withColumns({c: r6(c) for c in ("value_mean", "value_std", "value_median")})


@query(
    "w15_window_mean_std",
    sql(
        """SELECT participant, session, window_id, window_id * 4 AS start_row, window_id * 4 + 7 AS end_row, round(avg(value), 6) AS value_mean,
 round(stddev_pop(value), 6) AS value_std, min(timestamp) AS start, max(timestamp) AS "end" FROM win GROUP BY ALL""",
        SIG, ROWS, _wins(8, 4),
    ),
)
def w15(spark, d):
    out = wn.window_stats(sig(spark, d), KEYS, ORDER, ["value"], 8, 4, stats=["mean", "std"])
    return out.withColumns(
        {"value_mean": r6("value_mean"), "value_std": r6("value_std"), "start_row": F.col("window_id") * 4, "end_row": F.col("window_id") * 4 + 7}
    )


@query(
    "w16_window_arrays",
    sql(
        """SELECT participant, session, window_id, CAST(rn - window_id * 4 AS INTEGER) AS i, CAST(CAST(value AS FLOAT) AS DOUBLE) AS value,
 min(timestamp) OVER (PARTITION BY participant, session, window_id) AS start, max(timestamp) OVER (PARTITION BY participant, session, window_id) AS "end" FROM win""",
        SIG, ROWS, _wins(8, 4),
    ),
)
def w16(spark, d):
    w = wn.window_arrays(sig(spark, d), KEYS, ORDER, ["value"], 8, 4)
    flat = w.select(*KEYS, "window_id", "start", "end", F.posexplode("features").alias("i", "x"))
    return flat.select(*KEYS, "window_id", "start", "end", "i", F.col("x")[0].cast("double").alias("value"))


@query(
    "w17_drop_null_label_windows",
    sql(
        """SELECT participant, session, window_id, round(avg(value), 6) AS value_mean FROM win GROUP BY participant, session, window_id
HAVING count(CASE WHEN event_id % 23 <> 0 THEN label END) = 8""",
        SIG, ROWS, _wins(8, 4),
    ),
)
def w17(spark, d):
    holes = sig(spark, d).withColumn("label", F.when(F.col("event_id") % 23 != 0, F.col("label")))
    out = wn.window_stats(holes, KEYS, ORDER, ["value"], 8, 4, stats=["mean"], label="label", drop_null_labels=True)
    return out.select(*KEYS, "window_id", r6("value_mean").alias("value_mean"))


@query(
    "w18_count_windows",
    sql("SELECT participant, session, n, CASE WHEN n >= 8 THEN (n - 8) // 4 + 1 ELSE 0 END AS windows FROM c", SIG, ROWS),
)
def w18(spark, d):
    n = sig(spark, d).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("windows", wn.count_windows(F.col("n"), 8, 4))


@query("w19_first_window", sql("SELECT participant, session, event_id, timestamp, value, rn FROM r WHERE rn < 8", SIG, ROWS))
def w19(spark, d):
    return wn.first_window(sig(spark, d).select(*KEYS, "event_id", "timestamp", "value"), KEYS, ORDER, 8)


@query(
    "w20_label_runs",
    sql(
        """WITH a AS (SELECT *, CASE WHEN lag(label) OVER w IS DISTINCT FROM label THEN 1 ELSE 0 END AS ch FROM sig
 WINDOW w AS (PARTITION BY participant, session ORDER BY timestamp)),
 b AS (SELECT *, CAST(sum(ch) OVER (PARTITION BY participant, session ORDER BY timestamp) AS BIGINT) AS run FROM a)
SELECT participant, session, run, min(timestamp) AS start, max(timestamp) AS "end", min(label) AS label, count(*) AS n FROM b GROUP BY participant, session, run""",
        SIG,
    ),
)
def w20(spark, d):
    return ts.label_runs(sig(spark, d), KEYS, "timestamp", "label")


@query(
    "w21_block_average",
    sql(
        """WITH p AS (SELECT *, rn - window_id * 4 AS i FROM win)
SELECT participant, session, window_id, i // 3 AS block, round(avg(value), 6) AS value FROM p GROUP BY participant, session, window_id, i // 3 HAVING count(*) = 3""",
        SIG, ROWS, _wins(8, 4),
    ),
)
def w21(spark, d):
    w = wn.row_windows(sig(spark, d), KEYS, ORDER, 8, 4)
    full = w.groupBy(*KEYS, "window_id").count().where("count = 8").drop("count")
    rows = w.join(full, [*KEYS, "window_id"]).withColumn("i", F.col("rn") - F.col("window_id") * 4)
    return wn.block_average(rows, [*KEYS, "window_id"], "i", ["value"], 3).withColumn("value", r6("value"))


@query(
    "w22_fix_length",
    sql(
        """WITH s AS (SELECT participant, session, window_id, value, timestamp, rn - window_id * 4 AS i FROM win),
 g AS (SELECT DISTINCT participant, session, window_id FROM s), j AS (SELECT *, unnest(generate_series(0, 9)) AS j FROM g)
SELECT j.participant, j.session, j.window_id, CAST(j.j AS INTEGER) AS j, coalesce(s.value, 0.0) AS value, CASE WHEN s.i IS NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS missing
FROM j LEFT JOIN s ON s.participant = j.participant AND s.session = j.session AND s.window_id = j.window_id AND s.i = j.j - 2""",
        SIG, ROWS, _wins(8, 4),
    ),
)
def w22(spark, d):
    w = wn.window_series(sig(spark, d), KEYS, ORDER, ["value"], 8, 4)
    real = F.transform("value", lambda v: F.struct(v.alias("value"), F.lit(0.0).alias("missing")))
    pad = F.struct(F.lit(0.0).alias("value"), F.lit(1.0).alias("missing"))
    fixed = w.select(*KEYS, "window_id", F.posexplode(wn.fix_length(real, 10, pad)).alias("j", "x"))
    return fixed.select(*KEYS, "window_id", "j", "x.value", "x.missing")


@query(
    "w23_stride",
    sql("SELECT participant, session, window_id, rn, value FROM win WHERE (rn - window_id * 4) % 3 = 0", SIG, ROWS, _wins(8, 4)),
)
def w23(spark, d):
    w = wn.window_series(sig(spark, d), KEYS, ORDER, ["value"], 8, 4)
    out = w.select(*KEYS, "window_id", F.posexplode("value").alias("i", "value")).where("i % 3 = 0")
    return out.select(*KEYS, "window_id", (F.col("window_id") * 4 + F.col("i")).alias("rn"), "value")


@query(
    "w24_thin_min_gap",
    sql(
        """WITH RECURSIVE nx AS (SELECT a.participant, a.session, a.timestamp, min(b.timestamp) AS nt FROM sig a JOIN sig b
 ON a.participant = b.participant AND a.session = b.session AND b.timestamp >= a.timestamp + 43200000 GROUP BY a.participant, a.session, a.timestamp),
 k AS (SELECT participant, session, min(timestamp) AS timestamp FROM sig GROUP BY participant, session
 UNION ALL SELECT k.participant, k.session, nx.nt FROM k JOIN nx ON k.participant = nx.participant AND k.session = nx.session AND k.timestamp = nx.timestamp WHERE nx.nt IS NOT NULL)
SELECT participant, session, timestamp FROM k""",
        SIG,
    ),
)
def w24(spark, d):
    return ts.thin_min_gap(sig(spark, d), KEYS, "timestamp", 12 * HOUR)


@query(
    "w25_overlapping_window_stats",
    sql(
        """SELECT participant, session, window_id, min(timestamp) AS start, round(avg(value), 6) AS value_mean, round(stddev_pop(value), 6) AS value_std,
 min(value) AS value_min, max(value) AS value_max FROM win GROUP BY participant, session, window_id""",
        SIG, ROWS, _wins(16, 2),
    ),
)
def w25(spark, d):
    out = wn.block_window_stats(sig(spark, d), KEYS, ORDER, ["value"], 16, 2)
    return out.withColumns({"value_mean": r6("value_mean"), "value_std": r6("value_std")})


@query(
    "w25_sliding_medians",
    sql(
        """SELECT participant, session, window_id, min(timestamp) AS start, round(median(value), 6) AS value_median FROM win GROUP BY participant, session, window_id""",
        NULLABLE, ROWS.replace("FROM sig", "FROM nul"), _wins(16, 2),
    ),
)
def w25_medians(spark, d):
    return sliding_medians(nullable(spark, d), KEYS, ORDER, ["value"], 16, 2).withColumn("value_median", r6("value_median"))


PEAKS = """pk AS (SELECT * FROM (SELECT participant, session, window_id, rn, value, rn - window_id * 8 AS i, lag(value, 1) OVER w AS a1, lag(value, 2) OVER w AS a2,
 lead(value, 1) OVER w AS b1, lead(value, 2) OVER w AS b2, avg(value) OVER v + 0.3::DOUBLE * (max(value) OVER v - avg(value) OVER v) AS th FROM win
 WINDOW w AS (PARTITION BY participant, session, window_id ORDER BY rn), v AS (PARTITION BY participant, session, window_id))
 WHERE value > a1 AND value > a2 AND value > b1 AND value > b2 AND value >= th),
 rr AS (SELECT * FROM (SELECT participant, session, window_id, i, (i - lag(i) OVER (PARTITION BY participant, session, window_id ORDER BY i)) * 200.0::DOUBLE AS rr FROM pk)
  WHERE rr BETWEEN 300 AND 2000),
 rd AS (SELECT *, rr - lag(rr) OVER (PARTITION BY participant, session, window_id ORDER BY i) AS dd FROM rr),
 allw AS (SELECT DISTINCT participant, session, window_id FROM win)"""


def _windows16(spark, d):
    s = sig(spark, d).withColumn("other", F.col("value") + F.col("event_id") % 5)
    return wn.window_series(s, KEYS, ORDER, ["value", "other"], 16, 8)


def _peaks(spark, d):
    return _windows16(spark, d).withColumn("peaks", sg.peak_candidates(F.col("value"), 0.3))


def _rr(spark, d):
    return _peaks(spark, d).withColumn("rr", sg.rr_intervals(F.col("peaks"), 5.0))


@query("w26_peak_candidates", sql("SELECT participant, session, window_id, CAST(i AS INTEGER) AS i, value FROM pk", SIG, ROWS, _wins(16, 8), PEAKS))
def w26(spark, d):
    out = _peaks(spark, d).select(*KEYS, "window_id", "value", F.explode("peaks").alias("i"))
    return out.select(*KEYS, "window_id", "i", F.get("value", F.col("i")).alias("value"))


@query(
    "w27_peak_refractory",
    sql(
        """WITH RECURSIVE k AS (SELECT participant, session, window_id, min(i) AS i FROM pk GROUP BY participant, session, window_id
 UNION ALL SELECT * FROM (SELECT k.participant, k.session, k.window_id, min(p.i) AS i FROM k JOIN pk p ON k.participant = p.participant AND k.session = p.session
  AND k.window_id = p.window_id AND p.i >= k.i + 5 GROUP BY k.participant, k.session, k.window_id))
SELECT participant, session, window_id, CAST(i AS INTEGER) AS i FROM k""",
        SIG, ROWS, _wins(16, 8), PEAKS,
    ),
)
def w27(spark, d):
    return _peaks(spark, d).select(*KEYS, "window_id", F.explode(sg.refractory(F.col("peaks"), 5)).alias("i"))


@query(
    "w28_find_peaks",
    sql(
        """WITH RECURSIVE rows_ AS (SELECT participant, session, timestamp, value, row_number() OVER (PARTITION BY participant, session ORDER BY timestamp, value) - 1 AS r FROM sig WHERE value IS NOT NULL),
 turns AS (SELECT *, CASE WHEN value = lag(value) OVER w THEN 0 ELSE 1 END AS new FROM rows_ WINDOW w AS (PARTITION BY participant, session ORDER BY r)),
 flats AS (SELECT *, sum(new) OVER (PARTITION BY participant, session ORDER BY r) AS flat FROM turns),
 runs AS (SELECT participant, session, flat, any_value(value) AS height, (min(r) + max(r)) // 2 AS pos FROM flats GROUP BY participant, session, flat),
 beside AS (SELECT *, lag(height) OVER w AS before, lead(height) OVER w AS after FROM runs WINDOW w AS (PARTITION BY participant, session ORDER BY flat)),
 tops AS (SELECT *, row_number() OVER (PARTITION BY participant, session ORDER BY height DESC, pos DESC) AS k FROM beside WHERE height > before AND height > after),
 kept AS (SELECT participant, session, k, [pos] AS held FROM tops WHERE k = 1
  UNION ALL SELECT t.participant, t.session, t.k, CASE WHEN len(list_filter(held, lambda p: abs(p - t.pos) < 3)) = 0 THEN list_append(held, t.pos) ELSE held END
   FROM kept JOIN tops t ON t.participant = kept.participant AND t.session = kept.session AND t.k = kept.k + 1),
 peaks AS (SELECT participant, session, unnest(max_by(held, k)) AS pos FROM kept GROUP BY participant, session),
 high AS (SELECT p.*, r.timestamp, r.value AS height FROM peaks p JOIN rows_ r ON r.participant = p.participant AND r.session = p.session AND r.r = p.pos),
 edge AS (SELECT h.participant, h.session, h.pos, h.timestamp, h.height, coalesce(max(CASE WHEN r.r < h.pos AND r.value > h.height THEN r.r END), -1) AS a,
   coalesce(min(CASE WHEN r.r > h.pos AND r.value > h.height THEN r.r END), 1000000000) AS b FROM high h JOIN rows_ r ON r.participant = h.participant AND r.session = h.session GROUP BY ALL),
 base AS (SELECT e.participant, e.session, e.timestamp, e.pos, e.height, min(CASE WHEN r.r <= e.pos THEN r.value END) AS low_a, min(CASE WHEN r.r >= e.pos THEN r.value END) AS low_b
   FROM edge e JOIN rows_ r ON r.participant = e.participant AND r.session = e.session AND r.r > e.a AND r.r < e.b GROUP BY ALL)
SELECT participant, session, timestamp, CAST(pos AS BIGINT) AS pos, height, round(height - greatest(low_a, low_b), 6) + 0.0::DOUBLE AS prominence FROM base WHERE height - greatest(low_a, low_b) >= 50""",
        SIG,
    ),
)
def w28(spark, d):
    return br.find_peaks(sig(spark, d), KEYS, "timestamp", "value", distance=3, min_prominence=50.0).withColumn("prominence", r6("prominence"))


@query("w29_bandpass")
def w29(spark, d):
    return br.bandpass(sig(spark, d), KEYS, "timestamp", "value", *BREATHING_BAND_HZ, 4.0)


@query("w30_breathing_rate")
def w30(spark, d):
    return br.breathing_rate(sig(spark, d), KEYS, "timestamp", "value", 4.0, BREATHING_BAND_HZ, 0.5, 5.0, 50.0)


@query("w30_breathing_rate_on_clock")
def w30b(spark, d):
    s = sig(spark, d)
    rate = br.breathing_rate_by_time(s.withColumn("timestamp", F.col("timestamp") / 1000.0), KEYS, "timestamp", "value", 2)
    base = s.select(*KEYS, (F.col("timestamp") / 1000.0).alias("timestamp"))
    return br.interpolate_on_clock(base, rate, KEYS, "timestamp", "breathing_rpm")


@query(
    "w31_moving_mean",
    sql(
        """SELECT participant, session, window_id, rn, round(avg(value) OVER (PARTITION BY participant, session, window_id ORDER BY rn
 ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS smooth FROM win""",
        SIG, ROWS, _wins(8, 4),
    ),
)
def w31(spark, d):
    w = wn.row_windows(sig(spark, d), KEYS, ORDER, 8, 4)
    n = F.count(F.lit(1)).over(Window.partitionBy(*KEYS, "window_id"))
    smooth = wn.moving_mean("value", [*KEYS, "window_id"], ["rn"])
    return w.withColumns({"_n": n, "smooth": smooth}).where("_n = 8").select(*KEYS, "window_id", "rn", r6("smooth").alias("smooth"))


# ---------------------------------------------------------------- window features
@query("f01_rr_intervals", sql("SELECT participant, session, window_id, rr FROM rr", SIG, ROWS, _wins(16, 8), PEAKS))
def f01(spark, d):
    return _rr(spark, d).select(*KEYS, "window_id", F.explode("rr").alias("rr"))


def _register_rr(key: str, name: str, expr: str, fn):
    stmt = f"""SELECT participant, session, window_id, round({expr}, 6) + 0.0::DOUBLE AS {name} FROM allw LEFT JOIN rd USING (participant, session, window_id)
GROUP BY participant, session, window_id"""

    @query(key, sql(stmt, SIG, ROWS, _wins(16, 8), PEAKS))
    def run(spark, d):
        return _rr(spark, d).select(*KEYS, "window_id", r6(fn(F.col("rr"))).alias(name))


_register_rr("f02_bpm", "bpm", "CASE WHEN count(rr) < 2 THEN 0 ELSE greatest(30, least(220, 60000 / avg(rr))) END", sg.bpm)
_register_rr("f03_sdnn", "sdnn", "CASE WHEN count(rr) < 3 THEN 0 ELSE stddev_pop(rr) END", sg.sdnn)
_register_rr("f04_rmssd", "rmssd", "CASE WHEN count(rr) < 2 THEN 0 ELSE sqrt(avg(dd * dd)) END", sg.rmssd)
_register_rr("f05_pnn50", "pnn50", "CASE WHEN count(rr) < 2 THEN 0 ELSE avg(CASE WHEN abs(dd) > 50 THEN 100.0::DOUBLE WHEN dd IS NOT NULL THEN 0 END) END", sg.pnn50)


@query(
    "f06_lf_hf",
    sql(
        """WITH s AS (SELECT participant, session, window_id, value, avg(value) OVER (PARTITION BY participant, session, window_id ORDER BY rn
 ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS m FROM win)
SELECT participant, session, window_id, round(CASE WHEN var_pop(value - m) < 1e-6 THEN 2 ELSE greatest(0.1, least(20, var_pop(m) / var_pop(value - m))) END, 6) AS lfhf
FROM s GROUP BY participant, session, window_id""",
        SIG, ROWS, _wins(16, 8),
    ),
)
def f06(spark, d):
    # the window's values stand in for a series of beat intervals
    return _windows16(spark, d).select(*KEYS, "window_id", r6(sg.lf_hf(F.col("value"))).alias("lfhf"))


@query(
    "f07_spo2",
    sql(
        """WITH s AS (SELECT participant, session, window_id, value AS a, value + event_id % 5 AS b FROM win)
SELECT participant, session, window_id, round(CASE WHEN avg(a) < 1e-6 OR avg(b) < 1e-6 OR max(a) - min(a) < 1e-6 THEN 0
 ELSE greatest(70, least(100, 110 - 25 * ((max(b) - min(b)) / avg(b)) / ((max(a) - min(a)) / avg(a)))) END, 6) AS spo2 FROM s GROUP BY participant, session, window_id""",
        SIG, ROWS, _wins(16, 8),
    ),
)
def f07(spark, d):
    return _windows16(spark, d).select(*KEYS, "window_id", r6(sg.spo2(F.col("value"), F.col("other"))).alias("spo2"))


@query(
    "f08_amplitude",
    sql("SELECT participant, session, window_id, round(max(value) - min(value), 6) AS amplitude FROM win GROUP BY ALL", SIG, ROWS, _wins(16, 8)),
)
def f08(spark, d):
    return _windows16(spark, d).select(*KEYS, "window_id", r6(sg.amplitude(F.col("value"))).alias("amplitude"))


@query(
    "f09_skewness",
    sql(
        """WITH m AS (SELECT *, avg(value) OVER (PARTITION BY participant, session, window_id) AS mu FROM win)
SELECT participant, session, window_id, round(CASE WHEN stddev_pop(value) < 1e-6 THEN 0
 ELSE greatest(-3, least(3, avg(pow(value - mu, 3)) / pow(stddev_pop(value), 3))) END, 6) + 0.0::DOUBLE AS skewness FROM m GROUP BY participant, session, window_id""",
        SIG, ROWS, _wins(16, 8),
    ),
)
def f09(spark, d):
    return _windows16(spark, d).select(*KEYS, "window_id", r6(sg.skewness(F.col("value"))).alias("skewness"))


@query(
    "f10_pulse_features",
    sql(
        """WITH hrv AS (SELECT participant, session, window_id, CASE WHEN count(rr) < 2 THEN 0 ELSE greatest(30, least(220, 60000 / avg(rr))) END AS bpm,
 CASE WHEN count(rr) < 3 THEN 0 ELSE stddev_pop(rr) END AS sdnn, CASE WHEN count(rr) < 2 THEN 0 ELSE sqrt(avg(dd * dd)) END AS rmssd,
 CASE WHEN count(rr) < 2 THEN 0 ELSE avg(CASE WHEN abs(dd) > 50 THEN 100.0::DOUBLE WHEN dd IS NOT NULL THEN 0 END) END AS pnn50
 FROM allw LEFT JOIN rd USING (participant, session, window_id) GROUP BY participant, session, window_id),
 s AS (SELECT participant, session, window_id, timestamp, value AS a, value + event_id % 5 AS b, avg(value) OVER (PARTITION BY participant, session, window_id) AS mu FROM win),
 w AS (SELECT participant, session, window_id, min(timestamp) AS start, max(a) - min(a) AS amplitude,
 CASE WHEN avg(a) < 1e-6 OR avg(b) < 1e-6 OR max(a) - min(a) < 1e-6 THEN 0 ELSE greatest(70, least(100, 110 - 25 * ((max(b) - min(b)) / avg(b)) / ((max(a) - min(a)) / avg(a)))) END AS spo2,
 CASE WHEN stddev_pop(a) < 1e-6 THEN 0 ELSE greatest(-3, least(3, avg(pow(a - mu, 3)) / pow(stddev_pop(a), 3))) END AS skewness FROM s GROUP BY participant, session, window_id)
SELECT participant, session, window_id, start, round(bpm, 6)::DOUBLE AS bpm, round(sdnn, 6)::DOUBLE AS sdnn, round(rmssd, 6)::DOUBLE AS rmssd, round(pnn50, 6)::DOUBLE AS pnn50,
 1.0::DOUBLE AS lfhf, round(spo2, 6) AS spo2, round(amplitude, 6) AS amplitude, round(skewness, 6) + 0.0::DOUBLE AS skewness FROM w JOIN hrv USING (participant, session, window_id)""",
        SIG, ROWS, _wins(16, 8), PEAKS,
    ),
)
def f10(spark, d):
    feats = _windows16(spark, d).withColumn("f", sg.pulse_features(F.col("value"), F.col("other"), 5.0, 0.3, 3))
    names = ["bpm", "sdnn", "rmssd", "pnn50", "lfhf", "spo2", "amplitude", "skewness"]
    return feats.select(*KEYS, "window_id", "start", *[r6(f"f.{n}").alias(n) for n in names])
