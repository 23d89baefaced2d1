"""Queries over joins, scaling, balancing and evaluation (operators J, M and the vector functions F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import LABEL_CODES, PSEUDO_LABEL_MIN
from ..functions import vectors as vf
from ..operators import balance as bl
from ..operators import encode as en
from ..operators import evaluate as ev
from ..operators import joins as jn
from ..operators import profile as pf
from ..operators import scale as sc
from ..operators import sketches
from ..operators import sets as st
from ..operators import timeseries as ts
from ..operators import windows as wn
from ..session import cut_lineage
from .bindings import HOUR, KEYS, MARKERS, NULLABLE, PRED, SIG, VEC, nullable, pred, r6, sensor, sig, sql, table, vec
from .registry import query
from .time_queries import BOUNDS, INTERVALS, LABELS, ORDER, ROWS, TWIN, _bounds, _interval_table, _intervals, _wins

QA = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


# ---------------------------------------------------------------- as-of and outer fusion
def _asof(right: str, cond: str = "TRUE") -> str:
    """Nearest row of one event type within six hours, earlier row on ties."""
    return f"""{right}_b AS (SELECT l.event_id, r.timestamp AS t, r.value AS v FROM base l ASOF JOIN (SELECT * FROM sig WHERE event_type = '{right}') r
 ON l.participant = r.participant AND l.session = r.session AND l.timestamp >= r.timestamp),
 {right}_f AS (SELECT l.event_id, r.timestamp AS t, r.value AS v FROM base l ASOF JOIN (SELECT * FROM sig WHERE event_type = '{right}') r
 ON l.participant = r.participant AND l.session = r.session AND l.timestamp < r.timestamp),
 {right}_n AS (SELECT base.event_id, CASE WHEN timestamp - b.t <= 21600000 AND (f.t IS NULL OR timestamp - b.t <= f.t - timestamp) THEN b.v
  WHEN f.t - timestamp <= 21600000 AND (b.t IS NULL OR f.t - timestamp < timestamp - b.t) THEN f.v END AS v
  FROM base LEFT JOIN {right}_b b USING (event_id) LEFT JOIN {right}_f f USING (event_id))"""


BASE_VIEW = "base AS (SELECT * FROM sig WHERE event_type = 'view')"


def _base(spark, d):
    return sig(spark, d).where("event_type = 'view'").select(*KEYS, "timestamp", "event_id", "value")


@query(
    "j01_asof_nearest",
    sql(
        "SELECT participant, session, timestamp, event_id, value, n.v AS click_value FROM base LEFT JOIN click_n n USING (event_id)",
        SIG, BASE_VIEW, _asof("click"),
    ),
)
def j01(spark, d):
    return jn.asof_nearest(_base(spark, d), sensor(spark, d, "click"), "timestamp", KEYS, 6 * HOUR, ["click_value"])


@query(
    "j02_fuse_sensors_asof",
    sql(
        """SELECT participant, session, timestamp, event_id, value, c.v AS click_value, p.v AS purchase_value, e.v AS error_value FROM base
 LEFT JOIN click_n c USING (event_id) LEFT JOIN purchase_n p USING (event_id) LEFT JOIN error_n e USING (event_id)""",
        SIG, BASE_VIEW, _asof("click"), _asof("purchase"), _asof("error"),
    ),
)
def j02(spark, d):
    others = [(sensor(spark, d, k), [f"{k}_value"]) for k in ("click", "purchase", "error")]
    return jn.fuse_sensors_asof(_base(spark, d), others, KEYS, "timestamp", 6 * HOUR)


@query(
    "j03_fuse_sensors_outer",
    sql(
        """SELECT participant, session, timestamp, max(value) FILTER (event_type = 'click') AS click_value, max(value) FILTER (event_type = 'view') AS view_value,
 max(value) FILTER (event_type = 'error') AS error_value FROM sig WHERE event_type IN ('click', 'view', 'error') GROUP BY ALL""",
        SIG,
    ),
)
def j03(spark, d):
    return jn.fuse_sensors_outer([sensor(spark, d, k) for k in ("click", "view", "error")], KEYS, "timestamp")


@query(
    "j04_join_dimension",
    sql("SELECT event_id, participant, c_acctbal AS balance, c_mktsegment AS segment FROM sig LEFT JOIN customer ON participant = c_custkey", SIG),
)
def j04(spark, d):
    dim = table(spark, d, "customer").select(F.col("c_custkey").alias("participant"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return jn.join_dim(sig(spark, d).select("event_id", "participant"), dim, "participant")


LABELED = """span AS (SELECT participant, session, any_value(t0) AS t0, min(start) AS a, max("end") AS b, arg_max("end", ord) FILTER (label = 'activity') AS ae,
 arg_max(start, ord) FILTER (label = 'fatigue') AS fs FROM iv GROUP BY ALL),
 rel AS (SELECT s.* EXCLUDE (timestamp, label), s.timestamp - t0 AS timestamp, a, b, ae, fs FROM sig s JOIN span USING (participant, session)),
 cov AS (SELECT r.event_id, arg_max(i.label, i.ord) AS l FROM rel r JOIN iv i ON r.participant = i.participant AND r.session = i.session
  AND r.timestamp BETWEEN i.start AND i."end" GROUP BY ALL),
 lab AS (SELECT participant, session, event_id, timestamp, value, coalesce(l, CASE WHEN timestamp > ae AND timestamp < fs THEN 'pre_fatigue' ELSE 'unlabeled' END) AS label
  FROM rel LEFT JOIN cov USING (event_id) WHERE timestamp BETWEEN a AND b)"""


def _relative(spark, d, iv):
    rows = sig(spark, d).select(*KEYS, "timestamp", "event_id", "value")
    return en.relative_time(rows, iv.select(*KEYS, "t0").distinct(), KEYS, "timestamp")


@query("j05_label_rows", sql("SELECT participant, session, event_id, timestamp, value, label FROM lab", MARKERS, INTERVALS, LABELED))
def j05(spark, d):
    iv = _interval_table(spark, d)
    return jn.label_rows(_relative(spark, d, iv), iv, LABELS, KEYS, "timestamp")


@query(
    "j05_label_rows_inside",
    sql("SELECT participant, session, event_id, timestamp, l AS label FROM rel JOIN cov USING (event_id)", MARKERS, INTERVALS, LABELED),
)
def j05b(spark, d):
    iv = _interval_table(spark, d)
    return jn.label_rows(_relative(spark, d, iv), iv, LABELS, KEYS, "timestamp", which="first", outside="drop").drop("value")


@query(
    "j06_label_windows",
    sql(
        """WITH o AS (SELECT tw.participant, tw.session, window_id, tw.start, i.label, i.ord, least(tw."end", i."end" + i.t0) - greatest(tw.start, i.start + i.t0) AS ov
 FROM tw JOIN iv i ON tw.participant = i.participant AND tw.session = i.session),
 best AS (SELECT *, row_number() OVER (PARTITION BY participant, session, window_id ORDER BY ov DESC, ord) AS place FROM o WHERE ov > 0)
SELECT participant, session, window_id, CAST(start AS DOUBLE) AS start, label, CAST(ov AS DOUBLE) AS overlap FROM best WHERE place = 1""",
        MARKERS, INTERVALS, BOUNDS, TWIN,
    ),
)
def j06(spark, d):
    iv = _intervals(spark, d).withColumns({"start": F.col("start") + F.col("t0"), "end": F.col("end") + F.col("t0")})
    return jn.label_windows_overlap(_bounds(sig(spark, d)), iv, KEYS, "lo", "hi", 48 * HOUR, 24 * HOUR)


@query(
    "j07_window_rows",
    sql(
        """SELECT tw.participant, tw.session, window_id, event_type AS sensor, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std
FROM tw JOIN sig s ON s.participant = tw.participant AND s.session = tw.session AND s.timestamp >= tw.start AND s.timestamp < tw."end" GROUP BY ALL""",
        SIG, BOUNDS, TWIN,
    ),
)
def j07(spark, d):
    s = sig(spark, d)
    rows = wn.covering_windows(s.join(jn.broadcast_if_small(_bounds(s)), KEYS), "timestamp", "lo", "hi", 48 * HOUR, 24 * HOUR)
    return rows.groupBy(*KEYS, "window_id", F.col("event_type").alias("sensor")).agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("value")).alias("mean"), r6(F.stddev_pop("value")).alias("std")
    )


@query("j08_leave_one_session_out", sql("SELECT event_id, participant = 8 AND session = 1 AS is_test FROM sig", SIG))
def j08(spark, d):
    return jn.with_fold_flag(sig(spark, d), {"participant": 8, "session": 1}).select("event_id", "is_test")


@query(
    "j09_by_sessions",
    sql(
        """WITH k AS (SELECT DISTINCT participant, session FROM sig WHERE event_type = 'error' AND value > 60)
SELECT event_id, (participant, session) IN (SELECT (participant, session) FROM k) AS listed FROM sig""",
        SIG,
    ),
)
def j09(spark, d):
    s = sig(spark, d)
    k = s.where("event_type = 'error' AND value > 60").select(*KEYS).distinct()
    a, b = jn.by_sessions(s, k, KEYS, "semi"), jn.by_sessions(s, k, KEYS, "anti")
    return a.select("event_id", F.lit(True).alias("listed")).unionByName(b.select("event_id", F.lit(False).alias("listed")))


def _fold_scores(spark, d):
    p = pred(spark, d)
    a = ev.metrics(p, "y", "p", ["fold"]).select("fold", F.lit(1).alias("session"), F.col("f1_macro").alias("f1"))
    b = ev.metrics(p.withColumn("p", 1 - F.col("p")), "y", "p", ["fold"]).select("fold", F.lit(1).alias("session"), F.col("f1_macro").alias("f1"))
    return a, b.where("fold <> 5")


def _f1(name: str, p: str) -> str:
    return f"""{name} AS (SELECT fold, avg(CASE WHEN s + q > 0 THEN 2.0::DOUBLE * t / (s + q) ELSE 0 END) AS f1 FROM
 (SELECT fold, c, count(*) FILTER (y = c) AS s, count(*) FILTER ({p} = c) AS q, count(*) FILTER (y = c AND {p} = c) AS t FROM pred, (SELECT unnest([0, 1]) AS c) GROUP BY fold, c)
 WHERE s + q > 0 GROUP BY fold)"""


FOLD_SCORES = (_f1("fa", "p"), _f1("fb", "(1 - p)"))


@query(
    "j10_pair_folds",
    sql(
        "SELECT fa.fold, 1 AS session, round(fa.f1, 6) AS score_a, round(fb.f1, 6) AS score_b, round(fb.f1 - fa.f1, 6) AS delta FROM fa LEFT JOIN fb ON fa.fold = fb.fold AND fb.fold <> 5",
        PRED, *FOLD_SCORES,
    ),
)
def j10(spark, d):
    a, b = _fold_scores(spark, d)
    out = jn.pair_folds(a, b, ["fold", "session"], "f1")
    return out.withColumns({c: r6(c) for c in ("score_a", "score_b", "delta")})


PLAN = """cnt AS (SELECT session, label, count(*) AS n FROM vec GROUP BY ALL),
 plan AS (SELECT *, least(5, min(n) OVER (PARTITION BY session) - 1) AS k, max(n) OVER (PARTITION BY session) - n AS need FROM cnt)"""


@query(
    "j11_knn_within",
    sql(
        """WITH p AS (SELECT a.session, a.label, a.vec_id AS qid, b.vec_id AS nid, list_sum(list_transform(list_zip(a.vec, b.vec), lambda z: (z[1] - z[2]) ** 2)) AS d2
 FROM vec a JOIN vec b ON a.session = b.session AND a.label = b.label AND a.vec_id <> b.vec_id),
 r AS (SELECT *, row_number() OVER (PARTITION BY session, label, qid ORDER BY d2, nid) AS rank FROM p)
SELECT r.session, r.label, qid, nid, round(d2, 6) AS d2, rank FROM r JOIN plan ON r.session = plan.session AND r.label = plan.label WHERE rank <= k""",
        VEC, PLAN,
    ),
)
def j11(spark, d):
    v = vec(spark, d)
    near = bl.knn_within(v, ["session", "label"], "vec_id", "vec", bl.MAX_K)
    k = bl.smote_plan(v, ["session"], "label").select("session", "label", "k")
    out = near.join(jn.broadcast_if_small(k), ["session", "label"]).where("rank <= k")
    return out.select("session", "label", "qid", "nid", r6("d2").alias("d2"), "rank")


@query(
    "j12_nearest_row",
    sql(
        """WITH p AS (SELECT a.session, a.vec_id AS qid, b.vec_id AS nid, list_sum(list_transform(list_zip(a.vec, b.vec), lambda z: (z[1] + 0.05::DOUBLE - z[2]) ** 2)) AS d2
 FROM vec a JOIN vec b ON a.session = b.session), r AS (SELECT *, row_number() OVER (PARTITION BY session, qid ORDER BY d2, nid) AS k FROM p)
SELECT session, qid, nid, round(d2, 6) AS d2 FROM r WHERE k = 1""",
        VEC,
    ),
)
def j12(spark, d):
    v = vec(spark, d)
    shifted = v.withColumn("vec", F.transform("vec", lambda x: x + F.lit(0.05)))
    return bl.nearest_row(shifted, v, ["session"], "vec_id", "vec").withColumn("d2", r6("d2"))


@query(
    "j13_lerp_hourly",
    sql(
        """WITH h AS (SELECT CAST(floor(timestamp / 3600000) AS BIGINT) AS hour, avg(value) AS v FROM sig GROUP BY ALL)
SELECT event_id, s.timestamp, CAST(floor(s.timestamp / 3600000) AS BIGINT) AS hour, round(a.v + (b.v - a.v) * (s.timestamp / 3600000 - a.hour), 6) AS hourly_lerp FROM sig s
JOIN h a ON a.hour = floor(s.timestamp / 3600000) JOIN h b ON b.hour = a.hour + 1""",
        SIG,
    ),
)
def j13(spark, d):
    s = sig(spark, d).select("event_id", "timestamp", "value")
    hourly = s.groupBy(F.floor(F.col("timestamp") / HOUR).alias("hour")).agg(F.avg("value").alias("hourly"))
    return jn.lerp_hourly(s.drop("value"), hourly, "timestamp", "hourly").withColumn("hourly_lerp", r6("hourly_lerp"))


def _centroids(v):
    """Mean vector of every label: the bounded landmark set."""
    means = v.select("label", F.posexplode("vec").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    rows = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("c")).orderBy("label").collect()
    return [r["label"] for r in rows], [[x["x"] for x in r["c"]] for r in rows]


CENTROIDS = """mean AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(range(1, 65)) AS i, unnest(vec) AS x FROM vec) GROUP BY label, i),
 cen AS (SELECT label AS landmark, list(x ORDER BY i) AS c FROM mean GROUP BY label)"""


@query(
    "j14_landmark_kernel",
    sql("SELECT vec_id, CAST(landmark AS INTEGER) AS landmark, round(list_dot_product(vec, c) ** 2, 6) AS k FROM vec, cen", VEC, CENTROIDS),
)
def j14(spark, d):
    v = vec(spark, d)
    labels, marks = _centroids(v)
    out = jn.landmark_kernel(v, "vec", marks).select("vec_id", F.posexplode("kernel").alias("i", "k"))
    return out.select("vec_id", F.get(F.lit(labels), F.col("i")).cast("int").alias("landmark"), r6("k").alias("k"))


GRID15 = """g AS (SELECT participant, session, window_id, count(*) FILTER (label = 1) AS a, count(*) FILTER (label = 3) AS b FROM win GROUP BY ALL)"""


def _grid_and_preds(spark, d):
    w = wn.row_windows(sig(spark, d), KEYS, ORDER, 8, 4).groupBy(*KEYS, "window_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 1).alias("a"), F.count_if(F.col("label") == 3).alias("b")
    ).where("n = 8")
    on = [*KEYS, "window_id"]
    return w.select(*on), [("first", w.where("a > 0").select(*on, F.col("a").alias("p1"))), ("second", w.where("b > 0").select(*on, F.col("b").alias("p2")))], on


@query(
    "j15_align_predictions",
    sql(
        "SELECT participant, session, window_id, CASE WHEN a = 0 THEN 'no_first' WHEN b = 0 THEN 'no_second' END AS lost FROM g",
        SIG, ROWS, _wins(8, 4), GRID15,
    ),
)
def j15(spark, d):
    grid, preds, on = _grid_and_preds(spark, d)
    return jn.align_predictions(grid, preds, on).select(*on, "lost")


@query(
    "j15_alignment_report",
    sql(
        """SELECT count(*) AS n, count(*) FILTER (a = 0 OR b = 0) AS n_lost, round(count(*) FILTER (a = 0 OR b = 0) * 100.0::DOUBLE / count(*), 6) AS lost_percent,
 count(*) FILTER (a = 0 OR b = 0) * 100.0::DOUBLE / count(*) > 20 AS alert FROM g""",
        SIG, ROWS, _wins(8, 4), GRID15,
    ),
)
def j15b(spark, d):
    grid, preds, on = _grid_and_preds(spark, d)
    return jn.alignment_report(jn.align_predictions(grid, preds, on)).withColumn("lost_percent", r6("lost_percent"))


# ---------------------------------------------------------------- flagship
@query(
    "session_windows",
    sql(
        """WITH hr AS (SELECT participant, session, CAST(floor(timestamp / 3600000) AS BIGINT) AS b, avg(value) AS value FROM sig GROUP BY ALL),
 base AS (SELECT r.participant, r.session, r.b * 3600000.0::DOUBLE - t0 AS timestamp, r.b AS event_id, value, a, span.b AS z, ae, fs FROM hr r JOIN span USING (participant, session)),
 click AS (SELECT s.participant, s.session, s.timestamp - t0 AS timestamp, value FROM sig s JOIN span USING (participant, session) WHERE event_type = 'click'),
 bk AS (SELECT l.participant, l.session, l.event_id, r.timestamp AS t, r.value AS v FROM base l ASOF JOIN click r ON l.participant = r.participant AND l.session = r.session AND l.timestamp >= r.timestamp),
 fw AS (SELECT l.participant, l.session, l.event_id, r.timestamp AS t, r.value AS v FROM base l ASOF JOIN click r ON l.participant = r.participant AND l.session = r.session AND l.timestamp < r.timestamp),
 fused AS (SELECT base.*, CASE WHEN timestamp - bk.t <= 21600000 AND (fw.t IS NULL OR timestamp - bk.t <= fw.t - timestamp) THEN bk.v
   WHEN fw.t - timestamp <= 21600000 AND (bk.t IS NULL OR fw.t - timestamp < timestamp - bk.t) THEN fw.v END AS click_value
   FROM base LEFT JOIN bk USING (participant, session, event_id) LEFT JOIN fw USING (participant, session, event_id) WHERE timestamp BETWEEN a AND z),
 cv AS (SELECT f.participant, f.session, f.event_id, arg_max(i.label, i.ord) AS l FROM fused f JOIN iv i ON f.participant = i.participant AND f.session = i.session
   AND f.timestamp BETWEEN i.start AND i."end" GROUP BY ALL),
 lb AS (SELECT f.*, CASE coalesce(l, CASE WHEN timestamp > ae AND timestamp < fs THEN 'pre_fatigue' ELSE 'unlabeled' END)
   WHEN 'activity' THEN 1 WHEN 'pre_fatigue' THEN 2 WHEN 'fatigue' THEN 3 ELSE -1 END AS label,
   row_number() OVER (PARTITION BY f.participant, f.session ORDER BY timestamp) - 1 AS rn, count(*) OVER (PARTITION BY f.participant, f.session) AS n FROM fused f LEFT JOIN cv USING (participant, session, event_id)),
 w AS (SELECT *, unnest(generate_series(greatest(0, CAST(ceil((rn - 7) / 4) AS BIGINT)), rn // 4)) AS window_id FROM lb),
 ww AS (SELECT * FROM w WHERE window_id * 4 + 8 <= n),
 mj AS (SELECT participant, session, window_id, label, row_number() OVER (PARTITION BY participant, session, window_id ORDER BY count(*) DESC, label) AS k FROM ww GROUP BY participant, session, window_id, label)
SELECT ww.participant, ww.session, ww.window_id, round(avg(value), 6) AS value_mean, round(stddev_pop(value), 6) AS value_std, round(min(value), 6) AS value_min, round(max(value), 6) AS value_max,
 round(median(value), 6) AS value_median, round(avg(click_value), 6) AS click_value_mean, round(stddev_pop(click_value), 6) AS click_value_std, min(click_value) AS click_value_min,
 max(click_value) AS click_value_max, round(median(click_value), 6) AS click_value_median, min(timestamp) AS start, max(timestamp) AS "end", any_value(mj.label) AS label
FROM ww JOIN mj ON mj.k = 1 AND ww.participant = mj.participant AND ww.session = mj.session AND ww.window_id = mj.window_id GROUP BY ww.participant, ww.session, ww.window_id""",
        MARKERS, INTERVALS, LABELED,
    ),
)
def session_windows(spark, d):
    """Dedup, resample, fuse by nearest stamp, label from markers, window, summarise.

    The interval table is tiny next to the signals and read three times, so it is written once.
    The raw click stream has no known top rate, so the fusion measures its chunks; after it hourly rows
    bound a 30-day chunk at 720 rows and the later scans need no measuring pass.
    """
    width = 720 * HOUR
    s = pf.keep_one(sig(spark, d).select(*KEYS, "timestamp", "value", "event_id"), [*KEYS, "timestamp"], "event_id").drop("event_id")
    iv = _interval_table(spark, d)
    hourly = ts.resample_mean(s, KEYS, "timestamp", ["value"], HOUR, gaps=False)
    fused = jn.asof_nearest(hourly, sensor(spark, d, "click"), "timestamp", KEYS, 6 * HOUR, ["click_value"])
    rel = en.relative_time(fused, iv.groupBy(*KEYS).agg(F.min("t0").alias("t0")), KEYS, "timestamp")
    labeled = jn.label_rows(rel, iv, LABELS, KEYS, "timestamp", chunk_width=width)
    coded = en.encode_labels(labeled, "label", LABEL_CODES).withColumn("label", F.col("label").cast("int"))
    out = wn.window_stats(coded, KEYS, ["timestamp"], ["value", "click_value"], 8, 4, label="label", chunk_width=width)
    fix = [f"{c}_{s}" for c in ("value", "click_value") for s in ("mean", "std", "median")] + ["value_min", "value_max"]
    return out.withColumns({c: r6(c) for c in fix})


# ---------------------------------------------------------------- scaling
@query(
    "m01_robust_scale",
    sql(
        """WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.75) AS b FROM nul)
SELECT event_id, round((value - m) / (b - a), 6) + 0.0::DOUBLE AS value FROM nul, q""",
        NULLABLE,
    ),
)
def m01(spark, d):
    n = nullable(spark, d).select("event_id", "value")
    return sc.apply_scaler(n, sc.robust_fit(n, ["value"])).withColumn("value", r6("value"))


@query(
    "m02_robust_fit_by_sensor",
    sql("SELECT event_type, 'value' AS \"column\", round(quantile_cont(value, 0.5), 6) AS center, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS scale FROM sig GROUP BY event_type", SIG),
)
def m02(spark, d):
    return sc.robust_fit_by(sig(spark, d), ["event_type"], ["value"]).withColumns({"center": r6("center"), "scale": r6("scale")})


@query(
    "m03_robust_fit_folds",
    sql(
        """WITH f AS (SELECT DISTINCT participant, session FROM sig)
SELECT f.participant, f.session, 'value' AS "column", round(quantile_cont(s.value, 0.5), 6) AS center, round(quantile_cont(s.value, 0.75) - quantile_cont(s.value, 0.25), 6) AS scale
FROM f JOIN sig s ON NOT (s.participant = f.participant AND s.session = f.session) GROUP BY ALL""",
        SIG,
    ),
)
def m03(spark, d):
    return sc.robust_fit_folds(sig(spark, d), KEYS, ["value"]).withColumns({"center": r6("center"), "scale": r6("scale")})


@query("m03_sketched_folds")
def m03_sketched(spark, d):
    return sketches.robust_fit_folds(sketches.sketch(sig(spark, d), KEYS, ["value"]), KEYS).withColumns({"center": r6("center"), "scale": r6("scale")})


@query(
    "m03_moments_folds",
    sql(
        """WITH f AS (SELECT DISTINCT participant, session FROM sig)
SELECT f.participant, f.session, round(avg(s.value), 6) AS value_mean, round(stddev_pop(s.value), 6) AS value_std
FROM f JOIN sig s ON NOT (s.participant = f.participant AND s.session = f.session) GROUP BY ALL""",
        SIG,
    ),
)
def m03b(spark, d):
    return sc.leave_one_out_moments(sig(spark, d), KEYS, ["value"]).withColumns({"value_mean": r6("value_mean"), "value_std": r6("value_std")})


@query(
    "m04_zscore",
    "SELECT l_orderkey, l_linenumber, " + ", ".join(f"round(({c} - (SELECT avg({c}) FROM lineitem)) / (SELECT stddev_pop({c}) FROM lineitem), 6) + 0.0::DOUBLE AS {c}" for c in QA[:2]) + " FROM lineitem",
)
def m04(spark, d):
    q = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *QA[:2])
    return sc.zscore(q, QA[:2]).withColumns({c: r6(c) for c in QA[:2]})


# ---------------------------------------------------------------- balancing and splits
@query(
    "m05_smote_counts",
    sql(
        """WITH c AS (SELECT participant, session, label, count(*) AS n FROM sig WHERE label >= 0 GROUP BY ALL),
 p AS (SELECT *, max(n) OVER w AS mx, min(n) OVER w AS mn, count(*) OVER w AS k FROM c WINDOW w AS (PARTITION BY participant, session))
SELECT participant, session, label, CASE WHEN k >= 2 AND mn >= 2 THEN mx ELSE n END AS n FROM p""",
        SIG,
    ),
)
def m05(spark, d):
    out = _smote(spark, d)
    return out.groupBy(*KEYS, "label").agg(F.count(F.lit(1)).alias("n"))


def _smote(spark, d):
    return bl.smote(sig(spark, d).where("label >= 0"), KEYS, ["value"], "label", "event_id", "timestamp")


@query("m05_smote_rows")
def m05b(spark, d):
    return _smote(spark, d)


MD5 = "CAST('0x' || substr(md5(concat_ws('|', '42', {0})), 1, 13) AS BIGINT)"


@query(
    "m06_smote_windows",
    sql(
        f"""WITH c AS (SELECT session, label, count(*) AS n FROM vec GROUP BY ALL),
 t AS (SELECT session, max(n) AS hi, min(n) AS lo, count(*) AS k FROM c GROUP BY ALL),
 plan AS (SELECT session, label, n, hi - n AS need, least(5, lo - 1) AS k FROM c JOIN t USING (session) WHERE t.k >= 2 AND lo >= 2 AND hi > n),
 d AS (SELECT session, label, n, k, unnest(generate_series(0, need - 1)) AS i FROM plan),
 r AS (SELECT *, row_number() OVER (PARTITION BY session, label ORDER BY vec_id) AS pos FROM vec),
 b AS (SELECT d.session, d.label, d.i, r.vec_id, r.vec, {MD5.format("d.session, d.label, d.i, 'pick'")} % d.k + 1 AS pick
  FROM d JOIN r ON r.session = d.session AND r.label = d.label AND r.pos = {MD5.format("d.session, d.label, d.i, 'base'")} % d.n + 1),
 q AS (SELECT DISTINCT session, label, vec_id, vec FROM b),
 m AS (SELECT q.session, q.label, q.vec_id, o.vec_id AS nid, row_number() OVER (PARTITION BY q.session, q.label, q.vec_id ORDER BY list_distance(q.vec, o.vec), o.vec_id) AS pick
  FROM q JOIN vec o ON o.session = q.session AND o.label = q.label AND o.vec_id <> q.vec_id)
SELECT b.session, b.label, b.i, b.vec_id AS base_id, m.nid AS neighbour_id, CAST(len(b.vec) AS INTEGER) AS width
FROM b JOIN m ON m.session = b.session AND m.label = b.label AND m.vec_id = b.vec_id AND m.pick = b.pick""",
        VEC,
    ),
)
def m06(spark, d):
    made = bl.smote_vectors(vec(spark, d), ["session"], "label", "vec_id", "vec")
    return made.select("session", "label", "i", "base_id", "neighbour_id", F.size("vec").alias("width"))


@query(
    "m14_split_sessions",
    sql(
        f"""WITH s AS (SELECT participant, session, row_number() OVER (ORDER BY {MD5.format('participant, session')}, participant, session) AS k, count(*) OVER () AS n
 FROM (SELECT DISTINCT participant, session FROM sig))
SELECT participant, session, CASE WHEN k <= floor(0.9::DOUBLE * n) THEN 'train' ELSE 'validation' END AS part FROM s""",
        SIG,
    ),
)
def m14(spark, d):
    return bl.split_sessions(sig(spark, d), KEYS, 0.9)


@query(
    "m15_pick_validation",
    sql(
        f"""WITH s AS (SELECT participant, session, row_number() OVER (ORDER BY {MD5.format('participant, session')}, participant, session) AS k, count(*) OVER () AS n
 FROM (SELECT DISTINCT participant, session FROM sig)), f AS (SELECT *, unnest([1, 2]) AS slot FROM s)
SELECT f.participant, f.session, CAST(slot AS INTEGER) AS slot, s.participant AS val_participant, s.session AS val_session FROM f JOIN s ON s.k = (f.k - 1 + slot) % f.n + 1""",
        SIG,
    ),
)
def m15(spark, d):
    return bl.pick_validation(sig(spark, d), KEYS, 2)


@query(
    "m16_stratified_split",
    sql(
        f"""WITH s AS (SELECT y, doc_id, row_number() OVER (PARTITION BY y ORDER BY {MD5.format('doc_id')}, doc_id) AS k, count(*) OVER (PARTITION BY y) AS n FROM pred)
SELECT y, doc_id, CASE WHEN k <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN k <= floor(n * (0.7::DOUBLE + 0.2::DOUBLE)) THEN 'valid' ELSE 'test' END AS part FROM s""",
        PRED,
    ),
)
def m16(spark, d):
    return bl.stratified_split(pred(spark, d).select("y", "doc_id"), ["y"], ["doc_id"])


@query(
    "m30_cap_rows",
    sql(f"SELECT y, doc_id FROM (SELECT y, doc_id, row_number() OVER (PARTITION BY y ORDER BY {MD5.format('doc_id')}, doc_id) AS k FROM pred) WHERE k <= 40", PRED),
)
def m30(spark, d):
    return bl.cap_rows(pred(spark, d).select("y", "doc_id"), ["y"], "doc_id", 40)


# ---------------------------------------------------------------- probability vectors
PROBS = """sm AS (SELECT vec_id, label, session, list_transform(vec[1:4], lambda x: exp(8 * x - list_max(list_transform(vec[1:4], lambda y: 8 * y)))) AS e FROM vec),
 pr AS (SELECT vec_id, label, session, list_transform(e, lambda x: x / list_sum(e)) AS p FROM sm),
 sm2 AS (SELECT vec_id, list_transform(vec[5:8], lambda x: exp(8 * x - list_max(list_transform(vec[5:8], lambda y: 8 * y)))) AS e FROM vec),
 pr2 AS (SELECT vec_id, list_transform(e, lambda x: x / list_sum(e)) AS q FROM sm2)"""


def _probs(spark, d):
    """Four-class distributions of two made-up predictors from the first embedding values."""
    v = vec(spark, d)

    def dist(start):
        return vf.softmax(F.transform(F.slice("vec", start, 4), lambda x: x * 8))

    return v.select("vec_id", "label", "session", dist(1).alias("p"), dist(5).alias("q"), dist(9).alias("s"), (F.col("label") % 4).alias("y"))


@query("f11_softmax", sql("SELECT vec_id, CAST(unnest([0, 1, 2, 3]) AS INTEGER) AS i, round(unnest(p), 6) AS p FROM pr", VEC, PROBS))
def f11(spark, d):
    return _probs(spark, d).select("vec_id", F.posexplode("p").alias("i", "p")).withColumn("p", r6("p"))


@query(
    "f12_argmax",
    sql("SELECT vec_id, CAST(list_position(p, list_max(p)) - 1 AS INTEGER) AS argmax, round(list_max(p), 6) AS confidence FROM pr", VEC, PROBS),
)
def f12(spark, d):
    return _probs(spark, d).select("vec_id", vf.argmax(F.col("p")).alias("argmax"), r6(vf.confidence(F.col("p"))).alias("confidence"))


SOFT = """so AS (SELECT *, list_transform(p, lambda x: pow(x, 1 / 3.0)) AS u FROM pr), sp AS (SELECT vec_id, list_transform(u, lambda x: x / list_sum(u)) AS ps FROM so),
 so2 AS (SELECT *, list_transform(q, lambda x: pow(x, 1 / 3.0)) AS u FROM pr2), sq AS (SELECT vec_id, list_transform(u, lambda x: x / list_sum(u)) AS qs FROM so2)"""


@query("f13_soften", sql("SELECT vec_id, CAST(unnest([0, 1, 2, 3]) AS INTEGER) AS i, round(unnest(ps), 6) AS p FROM sp", VEC, PROBS, SOFT))
def f13(spark, d):
    soft = _probs(spark, d).withColumn("soft", vf.soften(F.col("p"), 3.0))
    return soft.select("vec_id", F.posexplode("soft").alias("i", "p")).withColumn("p", r6("p"))


@query(
    "f14_distillation_loss",
    sql(
        """SELECT vec_id, round(0.3::DOUBLE * -ln(p[label % 4 + 1]) + 0.7::DOUBLE * 9 * list_sum(list_transform(list_zip(qs, ps), lambda z: z[1] * ln(z[1] / z[2]))), 6) AS loss
FROM pr JOIN sp USING (vec_id) JOIN sq USING (vec_id)""",
        VEC, PROBS, SOFT,
    ),
)
def f14(spark, d):
    loss = vf.distillation_loss(F.col("y"), F.col("p"), F.col("q"), 0.3, 3.0)
    return _probs(spark, d).select("vec_id", r6(loss).alias("loss"))


@query(
    "f15_ensemble_mean",
    sql("SELECT vec_id, CAST(unnest([0, 1, 2, 3]) AS INTEGER) AS i, round(unnest(list_transform(list_zip(p, q), lambda z: (z[1] + z[2]) / 2)), 6) AS p FROM pr JOIN pr2 USING (vec_id)", VEC, PROBS),
)
def f15(spark, d):
    out = _probs(spark, d).withColumn("m", vf.ensemble_mean(F.col("p"), F.col("q")))
    return out.select("vec_id", F.posexplode("m").alias("i", "p")).withColumn("p", r6("p"))


@query(
    "f16_state_summary",
    sql(
        """WITH s AS (SELECT vec_id, unnest(range(0, 64)) // 4 AS t, unnest(range(0, 64)) % 4 AS j, unnest(vec) AS x FROM vec),
 k AS (SELECT vec_id, j, avg(x) AS m, stddev_pop(x) AS sd, max(x) FILTER (t = 15) AS last FROM s WHERE t >= 2 GROUP BY vec_id, j)
SELECT vec_id, CAST(j AS INTEGER) AS i, round(last, 6) + 0.0::DOUBLE AS x FROM k UNION ALL SELECT vec_id, CAST(4 + j AS INTEGER), round(m, 6) + 0.0::DOUBLE FROM k
UNION ALL SELECT vec_id, CAST(8 + j AS INTEGER), round(sd, 6) + 0.0::DOUBLE FROM k""",
        VEC,
    ),
)
def f16(spark, d):
    # each vector read as 16 states of width 4
    states = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda t: F.slice("vec", t * 4 + 1, F.lit(4)))
    v = vec(spark, d).select("vec_id", states.alias("states")).withColumn("f", vf.state_summary(F.col("states"), washout=2))
    return v.select("vec_id", F.posexplode("f").alias("i", "x")).withColumn("x", r6("x"))


@query("f17_focal_loss", sql("SELECT vec_id, round(-0.25::DOUBLE * pow(1 - p[label % 4 + 1], 2) * ln(p[label % 4 + 1]), 6) AS loss FROM pr", VEC, PROBS))
def f17(spark, d):
    return _probs(spark, d).select("vec_id", r6(vf.focal_loss(F.col("y"), F.col("p"))).alias("loss"))


# ---------------------------------------------------------------- evaluation
@query(
    "m19_pseudo_label",
    sql("SELECT vec_id, CAST(list_position(p, list_max(p)) - 1 AS INTEGER) AS pseudo_label, round(list_max(p), 6) AS confidence FROM pr WHERE list_max(p) > 0.7", VEC, PROBS),
)
def m19(spark, d):
    out = ev.pseudo_label(_probs(spark, d), "p", PSEUDO_LABEL_MIN)
    return out.select("vec_id", "pseudo_label", r6("confidence").alias("confidence"))


@query(
    "m19_pseudo_label_report",
    sql("SELECT CAST(list_position(p, list_max(p)) - 1 AS INTEGER) AS pseudo_label, count(*) FILTER (list_max(p) > 0.7) AS kept, count(*) AS total FROM pr GROUP BY 1", VEC, PROBS),
)
def m19b(spark, d):
    return ev.pseudo_label_report(_probs(spark, d), "p", PSEUDO_LABEL_MIN)


@query(
    "u02_add_pseudo_labels",
    sql(
        """SELECT vec_id, CAST(label % 4 AS INTEGER) AS y, FALSE AS pseudo FROM pr WHERE session < 3
UNION ALL SELECT vec_id, CAST(list_position(p, list_max(p)) - 1 AS INTEGER), TRUE FROM pr WHERE session >= 3 AND list_max(p) > 0.7""",
        VEC, PROBS,
    ),
)
def u02(spark, d):
    p = _probs(spark, d)
    accepted = ev.pseudo_label(p.where("session >= 3"), "p", PSEUDO_LABEL_MIN)
    return ev.add_pseudo_labels(p.where("session < 3").select("vec_id", "y"), accepted, "y")


REPORT = """cr AS (SELECT fold, c AS class, count(*) FILTER (y = c) AS support, count(*) FILTER (p = c) AS predicted, count(*) FILTER (y = c AND p = c) AS tp
 FROM pred, (SELECT unnest([0, 1]) AS c) GROUP BY fold, c),
 cs AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS prec, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS rec,
 CASE WHEN support + predicted > 0 THEN 2 * tp / (support + predicted) ELSE 0 END AS f1 FROM cr WHERE support + predicted > 0)"""


@query(
    "m20_metrics",
    sql(
        """SELECT fold, round(avg(f1), 6) AS f1_macro, round(avg(rec) FILTER (support > 0), 6) AS balanced_accuracy, round(avg(prec), 6) AS precision_macro, round(avg(rec), 6) AS recall_macro,
 round(coalesce(max(prec) FILTER (class = 1), 0), 6) AS precision_focus, round(coalesce(max(rec) FILTER (class = 1), 0), 6) AS recall_focus,
 round(sum(tp) / sum(support), 6) AS accuracy, CAST(sum(support) AS BIGINT) AS n FROM cs GROUP BY fold""",
        PRED, REPORT,
    ),
)
def m20(spark, d):
    out = ev.metrics(pred(spark, d), "y", "p", ["fold"], focus=1)
    return out.select("fold", "n", *[r6(c).alias(c) for c in out.columns if c not in ("fold", "n")])


@query(
    "m21_class_report",
    sql("SELECT fold, class, support, predicted, tp, round(prec, 6) AS precision, round(rec, 6) AS recall, round(f1, 6) AS f1 FROM cs", PRED, REPORT),
)
def m21(spark, d):
    out = ev.class_report(pred(spark, d), "y", "p", ["fold"])
    return out.withColumns({c: r6(c) for c in ("precision", "recall", "f1")})


@query("m21_confusion", sql("SELECT fold, y, count(*) FILTER (p = 0) AS pred_0, count(*) FILTER (p = 1) AS pred_1 FROM pred GROUP BY fold, y", PRED))
def m21b(spark, d):
    return ev.confusion(pred(spark, d), "y", "p", [0, 1], ["fold"])


@query(
    "m22_binary_metrics",
    sql(
        """WITH c AS (SELECT fold, count(*) FILTER (y = 0 AND p = 0) AS tp, count(*) FILTER (y = 1 AND p = 0) AS fp, count(*) FILTER (y = 0 AND p = 1) AS fn, count(*) FILTER (y = 1 AND p = 1) AS tn FROM pred GROUP BY fold)
SELECT *, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision,
 round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1 FROM c""",
        PRED,
    ),
)
def m22(spark, d):
    # class remap: 0 is the positive class
    out = ev.binary_metrics(pred(spark, d), 1 - F.col("y"), 1 - F.col("p"), ["fold"])
    return out.withColumns({c: r6(c) for c in ("accuracy", "precision", "recall", "f1")})


@query(
    "m26_soft_labels",
    sql(
        """WITH e AS (SELECT pr.vec_id, label % 4 AS y, p, q, list_transform(list_zip(p, q), lambda z: (z[1] + z[2]) / 2) AS m FROM pr JOIN pr2 USING (vec_id)),
 a AS (SELECT avg(CASE WHEN list_position(p, list_max(p)) - 1 = y THEN 1.0::DOUBLE ELSE 0 END) AS ap, avg(CASE WHEN list_position(q, list_max(q)) - 1 = y THEN 1.0::DOUBLE ELSE 0 END) AS aq,
 avg(CASE WHEN list_position(m, list_max(m)) - 1 = y THEN 1.0::DOUBLE ELSE 0 END) AS am FROM e)
SELECT round(ap, 6) AS acc_p, round(aq, 6) AS acc_q, round(am, 6) AS acc_soft_label, round(greatest(ap, aq), 6) AS best_single, am > greatest(ap, aq) AS go FROM a""",
        VEC, PROBS,
    ),
)
def m26(spark, d):
    out = ev.soft_label_report(_probs(spark, d), "y", ["p", "q"])
    return out.select("go", *[r6(c).alias(c) for c in out.columns if c != "go"])


def _pairs(spark, d):
    """Discount against tax of every order line, in whole hundredths: many ties and zeros."""
    return table(spark, d, "lineitem").select(F.round(F.col("l_discount") * 100).alias("a"), F.round(F.col("l_tax") * 100).alias("b"))


@query(
    "m27_signed_ranks",
    """WITH x AS (SELECT round(l_discount * 100) - round(l_tax * 100) AS d FROM lineitem), g AS (SELECT abs(d) AS m, count(*) AS c, count(*) FILTER (d > 0) AS pos FROM x WHERE d <> 0 GROUP BY abs(d)),
 r AS (SELECT *, sum(c) OVER (ORDER BY m) - c + (c + 1) / 2.0::DOUBLE AS rk FROM g)
SELECT sum(rk * pos) AS w_plus, sum(rk * (c - pos)) AS w_minus, CAST(sum(c) AS BIGINT) AS n, CAST(sum(c * c * c - c) AS BIGINT) AS ties, least(sum(rk * pos), sum(rk * (c - pos))) AS w FROM r""",
)
def m27(spark, d):
    """The tie correction as a bigint as long as it fits, as an exact decimal(38,0) beyond, where the SQL's own bigint overflows."""
    out = cut_lineage(ev.signed_ranks(_pairs(spark, d), "a", "b"))
    return out if (out.first()["ties"] or 0) >= 2**63 else out.withColumn("ties", F.col("ties").cast("bigint"))


@query("m27_wilcoxon")
def m27b(spark, d):
    return ev.wilcoxon(_pairs(spark, d), "a", "b")


SUMMARY = """fs AS (SELECT 'toxic' AS model, * FROM fa UNION ALL SELECT 'inverse', * FROM fb),
 sm AS (SELECT model, count(*) AS n_folds, avg(f1) AS f1_mean, stddev_samp(f1) AS f1_std, min(f1) AS f1_min, max(f1) AS f1_max FROM fs WHERE NOT (model = 'inverse' AND fold = 5) GROUP BY model),
 sc AS (SELECT *, CASE WHEN model = 'toxic' THEN 12.5::DOUBLE END AS mb FROM sm),
 cm AS (SELECT *, round(0.5::DOUBLE * f1_mean + 0.3::DOUBLE * greatest(0, 1 - coalesce(mb, 100) / 500) + 0.2::DOUBLE * greatest(0, 1 - f1_std), 3) AS score FROM sc)"""


def _comparison(spark, d):
    a, b = _fold_scores(spark, d)
    folds = a.withColumn("model", F.lit("toxic")).unionByName(b.withColumn("model", F.lit("inverse")))
    summary = pf.summarize_folds(folds, ["model"], ["f1"])
    sizes = summary.where("model = 'toxic'").select("model", F.lit(12.5).alias("size_mb"), F.lit(12800.0).alias("size_kb"), F.lit(3).alias("n_files"))
    return ev.compare_models(summary, sizes)


@query(
    "m28_compare_models",
    sql(
        """SELECT model, n_folds, round(f1_mean, 6) AS f1_mean, round(f1_std, 6) AS f1_std, mb AS size_mb, score, CAST(row_number() OVER (ORDER BY score DESC, model) AS INTEGER) AS rank,
 CASE WHEN f1_mean >= 0.8 THEN 'excellent' WHEN f1_mean >= 0.6 THEN 'good' ELSE 'poor' END AS grade_f1 FROM cm""",
        PRED, *FOLD_SCORES, SUMMARY,
    ),
)
def m28(spark, d):
    return _comparison(spark, d).select("model", "n_folds", r6("f1_mean").alias("f1_mean"), r6("f1_std").alias("f1_std"), "size_mb", "score", "rank", "grade_f1")


@query("w32_rank_by_score", sql("SELECT model, score, CAST(row_number() OVER (ORDER BY score DESC, model) AS INTEGER) AS rank FROM cm", PRED, *FOLD_SCORES, SUMMARY))
def w32(spark, d):
    return st.rank_by(_comparison(spark, d).select("model", "score"), F.col("score").desc(), ["model"])


@query(
    "x01_majority_smoothing_batch",
    sql(
        """SELECT participant, session, event_id, CAST(avg(CASE WHEN value > 40 THEN 1.0::DOUBLE ELSE 0 END) OVER (PARTITION BY participant, session ORDER BY timestamp, event_id
 ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) > 0.5 AS INTEGER) AS smoothed FROM sig""",
        SIG,
    ),
)
def x01(spark, d):
    from ..streaming.live import smooth_majority_batch

    s = sig(spark, d).withColumn("hit", (F.col("value") > 40).cast("int"))
    return smooth_majority_batch(s, KEYS, ORDER, "hit", 5).select(*KEYS, "event_id", "smoothed")


@query(
    "x03_sliding_stats_batch",
    sql(
        """WITH k AS (SELECT participant, session, value, unnest([CAST(floor(timestamp / 86400000) AS BIGINT) - 1, CAST(floor(timestamp / 86400000) AS BIGINT)]) AS w FROM sig)
SELECT participant, session, (w * 86400000 + 1704067200000) AS start_ms, count(*) AS n, round(avg(value), 6) AS value_mean, round(stddev_pop(value), 6) AS value_std, min(value) AS value_min, max(value) AS value_max
FROM k GROUP BY participant, session, w HAVING count(*) >= 3""",
        SIG,
    ),
)
def x03(spark, d):
    from ..streaming.live import sliding_stats

    e = sig(spark, d).withColumn("ts", F.timestamp_millis((F.col("timestamp") + 1_704_067_200_000).cast("long")))
    out = sliding_stats(e, KEYS, "ts", ["value"], "48 hours", "24 hours", need=3)
    return out.select(
        *KEYS, F.unix_millis("start").alias("start_ms"), "n", r6("value_mean").alias("value_mean"), r6("value_std").alias("value_std"), "value_min", "value_max"
    )


