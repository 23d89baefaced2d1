"""Queries over decomposition, clustering, read-outs, tree models and streams (operators T, M and X)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import boosting as bo
from ..operators import decompose as dc
from ..operators import evaluate as ev
from ..operators import folds as fo
from ..operators import joins as jn
from ..operators import linear as ln
from ..operators import readout as ro
from ..operators import scale as sc
from ..operators import search as se
from ..operators import windows as wn
from ..operators.neighbours import as_vector
from ..session import cut_lineage
from ..streaming import live, ordered
from .bindings import HOUR, KEYS, ORIGIN, SIG, VEC, r6, sig, sql, table, vec
from .model_queries import _centroids
from .profile_queries import scratch
from .registry import query
from .time_queries import INTERVALS, LABELS, MARKERS, ORDER

QA = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
DIM = 64


def _components(spark, d):
    names = [f"v{i}" for i in range(DIM)]
    return ln.pca(vec(spark, d), "vec", names, 8)


@query("t02_top_loadings")
def t02(spark, d):
    return dc.top_loadings(_components(spark, d).loading_rows(spark)).withColumn("loading", r6("loading"))


@query("t04_best_per_component")
def t04(spark, d):
    return dc.best_per_component(_components(spark, d).loading_rows(spark))


@query("m07_pca_ratios")
def m07(spark, d):
    out = _components(spark, d).ratio_rows(spark)
    return out.select("component", *[r6(c).alias(c) for c in ("variance", "ratio", "cumulative")])


@query("m07_pca_scores")
def m07b(spark, d):
    out = _components(spark, d).scores(vec(spark, d), "vec").select("vec_id", F.posexplode("scores").alias("i", "score"))
    return out.withColumn("score", r6("score"))


@query("m08_pca_contributions")
def m08(spark, d):
    return dc.contributions(_components(spark, d).loading_rows(spark)).withColumn("contribution", r6("contribution"))


GROUPS = {"amount": ("quantitative", QA[:2]), "rates": ("quantitative", QA[2:]), "flag": ("categorical", ["l_returnflag"])}


@query("m09_mfa_contributions")
def m09(spark, d):
    _, shares, _ = dc.mfa(table(spark, d, "lineitem").select(*QA, "l_returnflag"), GROUPS)
    return shares.withColumn("percent", r6("percent"))


def _profiles(spark, d):
    s = sig(spark, d).withColumn("gap", F.col("timestamp") / HOUR)
    return dc.kmeans_profiles(s, "participant", ["value", "gap"], n_init=5)


@query("m10_kmeans_profiles")
def m10(spark, d):
    members, _, _ = _profiles(spark, d)
    return members


@query("m10_kmeans_group_profile")
def m10b(spark, d):
    _, profile, _ = _profiles(spark, d)
    return profile


@query("m11_projected_centroids")
def m11(spark, d):
    _, marks = _centroids(vec(spark, d))
    points = _components(spark, d).project(marks)
    return spark.createDataFrame([(i, j + 1, float(x)) for i, row in enumerate(points) for j, x in enumerate(row)], "center int, component int, x double")


@query("m12_isolation_forest")
def m12(spark, d):
    v = vec(spark, d)
    scores = dc.isolation_forest(v, "vec_id", "vec", trees=50)
    return dc.flag_share(scores, 0.4)


@query("m12_mean_decision")
def m12b(spark, d):
    v = vec(spark, d)
    return dc.mean_decision(dc.isolation_forest(v, "vec_id", "vec", trees=50), v.select(F.col("vec_id").alias("id"), "session"), ["session"])


@query("m13_loso_readout")
def m13(spark, d):
    out = ro.loso_readout(vec(spark, d), "session", "vec", DIM, "label", 10, 1.0)
    return ev.metrics(out, "label", "prediction", ["session"])


def _ml(spark, d) -> DataFrame:
    return ro.with_features(vec(spark, d).select("vec_id", "session", "vec", "label"), "vec", "label")


@query("m13_loso_random_forest")
def m13b(spark, d):
    data = cut_lineage(_ml(spark, d))
    return ro.loso_run(data, "session", [0, 1, 2, 3, 4], lambda train: ro.random_forest(10, 5).fit(train))


FOLD_SIZES = """c AS (SELECT participant, session, label, count(*) AS n FROM sig WHERE label >= 0 GROUP BY ALL),
 t AS (SELECT participant, session, participant % 3 AS fold, sum(n) AS n, CASE WHEN count(*) >= 2 AND min(n) >= 2 THEN count(*) * max(n) ELSE sum(n) END AS balanced FROM c GROUP BY ALL),
 w AS (SELECT fold, CASE WHEN n >= 8 THEN (n - 8) // 4 + 1 ELSE 0 END AS plain, CASE WHEN balanced >= 8 THEN (balanced - 8) // 4 + 1 ELSE 0 END AS made FROM t)"""


def _folds(spark, d):
    rows = sig(spark, d).select(*KEYS, "timestamp", "value", "label", "event_id")
    windows = fo.evaluation_windows(rows, KEYS, "event_id", "timestamp", ["value"], "label", 8, 4)
    windows = tuple(w.withColumn("fold", (F.col("participant") % 3).cast("int")) for w in windows)
    names = [f"value_{s}" for s in ("mean", "std", "min", "max", "median")]
    return fo.run_folds(windows, "fold", [0, 1, 2], names, "label", ro.random_forest(5, 4), threshold=0.35)


@query("m13_fold_pipeline")
def m13c(spark, d):
    return _folds(spark, d)


@query("m13_fold_pipeline_scaled")
def m13e(spark, d):
    """Scaled by each fold's balanced training rows; unlabelled windows of the left-out fold stay out."""
    rows = sig(spark, d).select(*KEYS, "timestamp", "value", "label", "event_id")
    balanced = fo.balanced_rows(rows, KEYS, "event_id", "timestamp", ["value"], "label")
    fold = (F.col("participant") % 3).cast("int")
    windows = fo.evaluation_windows(rows, KEYS, "event_id", "timestamp", ["value"], "label", 8, 4, balanced=balanced)
    scalers = sc.robust_fit_folds(balanced.withColumn("fold", fold), ["fold"], ["value"])
    names = [f"value_{s}" for s in ("mean", "std", "min", "max", "median")]
    return fo.run_folds(tuple(w.withColumn("fold", fold) for w in windows), "fold", [0, 1, 2], names, "label", ro.random_forest(5, 4), threshold=0.35, scalers=scalers, exclude_test_session=True)


@query(
    "m13_fold_windows",
    sql(
        """SELECT CAST(f.fold AS INTEGER) AS fold, CAST(sum(CASE WHEN w.fold <> f.fold THEN made END) AS BIGINT) AS n_train, CAST(sum(CASE WHEN w.fold = f.fold THEN plain END) AS BIGINT) AS n_test
FROM w, (SELECT unnest([0, 1, 2]) AS fold) f GROUP BY f.fold""",
        SIG, FOLD_SIZES,
    ),
)
def m13d(spark, d):
    return _folds(spark, d).select("fold", F.col("n_train").cast("bigint").alias("n_train"), F.col("n_test").cast("bigint").alias("n_test"))


CLASSES = list(range(10))
TREES = bo.Params(rounds=8, depth=3, learning_rate=0.3, bins=32)


@query("m17_boosted_trees")
def m17(spark, d):
    """Every vector scored by the trees that left its session out."""
    data = cut_lineage(_ml(spark, d))
    models = bo.fit(data, "vec", DIM, "label", CLASSES, TREES, "weight", "session", [0, 1, 2, 3, 4])
    out = None
    for m in models:
        part = m.predict(data.where(F.col("session") == m.left_out), "vec", CLASSES).select("vec_id", F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction"))
        out = part if out is None else out.unionByName(part)
    return out


@query("m17_left_out_against_majority")
def m17b(spark, d):
    """Macro F1 on each left-out session: boosted trees against the most frequent class of the other sessions."""
    data = cut_lineage(_ml(spark, d))
    folds = [0, 1, 2, 3, 4]
    own = bo.left_out_scores(data, "vec", DIM, "label", CLASSES, "session", folds, TREES, "weight").select("session", F.col("f1_macro"))
    counts = data.groupBy("session", F.col("label").cast("int").alias("label")).agg(F.count("*").alias("n"))
    rest = counts.select("label", "n", F.col("session").alias("of")).withColumn("session", F.explode(F.array(*[F.lit(f) for f in folds]))).where("of <> session")
    common = rest.groupBy("session", "label").agg(F.sum("n").alias("n")).groupBy("session").agg(F.max_by("label", F.struct("n", (-F.col("label")).alias("l"))).alias("p"))
    plain = ev.metrics(data.select("session", F.col("label").cast("int").alias("y")).join(common, "session"), "y", "p", ["session"])
    return own.join(plain.select("session", F.col("f1_macro").alias("f1_majority")), "session")


EDGES = [-0.15, -0.05, 0.05, 0.15]


@query(
    "m17_histogram_sums",
    sql(
        f"""SELECT CAST(cls AS INTEGER) AS cls, CAST(feature - 1 AS INTEGER) AS feature, CAST({" + ".join(f"(x > {e})::INT" for e in EDGES)} AS INTEGER) AS bin,
 round(sum(0.1::DOUBLE - CASE WHEN label = cls THEN 1 ELSE 0 END), 6) + 0.0 AS gradient, round(sum(0.09::DOUBLE), 6) AS curvature, count(*) AS rows
FROM (SELECT label, unnest(vec) AS x, generate_subscripts(vec, 1) AS feature FROM vec), (SELECT unnest(range(10)) AS cls) GROUP BY ALL""",
        VEC,
    ),
)
def m17c(spark, d):
    out = bo.root_histograms(vec(spark, d), "vec", "label", CLASSES, [np.array(EDGES)] * DIM)
    return out.withColumns({"gradient": r6("gradient"), "curvature": r6("curvature")})


@query("t03_feature_importances")
def t03(spark, d):
    model = ro.random_forest(10, 5).fit(_ml(spark, d))
    rows = [(i, float(x)) for i, x in enumerate(model.featureImportances.toArray())]
    imp = spark.createDataFrame(rows, "feature int, importance double")
    return imp.orderBy(F.col("importance").desc(), "feature").limit(20)


@query("m18_tune")
def m18(spark, d):
    data = cut_lineage(_ml(spark, d).withColumn("session", F.col("session").cast("int")))
    _, scores = ro.tune(data, ro.random_forest(5, 4), {"maxDepth": [3, 5], "numTrees": [5]}, "session", 5)
    return spark.createDataFrame([(i, float(s)) for i, s in enumerate(scores)], "candidate int, f1_macro double")


SPACE = {"depth": se.Whole(1, 3), "learning_rate": se.Real(0.05, 0.6, log=True), "l2": se.Real(0.1, 10.0, log=True), "rows": se.Real(0.6, 1.0), "features": se.Choice((0.5, 1.0))}


@query("m18_drawn_search")
def m18b(spark, d):
    """Four drawn candidates on one, two and four left-out sessions, the better half going on."""
    data = cut_lineage(_ml(spark, d))

    def evaluate(params, folds):
        chosen = bo.Params(rounds=3, bins=16, **params)
        return {r.session: r.f1_macro for r in bo.left_out_scores(data, "vec", DIM, "label", CLASSES, "session", folds, chosen, "weight").collect()}

    trials = se.halving(se.draw(SPACE, 4), [0, 1, 2, 3], evaluate)
    rows = [(t.candidate, len(t.scores), t.mean, *[float(t.params[k]) for k in sorted(SPACE)]) for t in trials]
    return spark.createDataFrame(rows, "candidate int, n_folds int, f1_macro double, " + ", ".join(f"{k} double" for k in sorted(SPACE)))


@query("m23_ridge_readout")
def m23(spark, d):
    v = vec(spark, d)
    w = ro.ridge_readout(v, "vec", DIM, "label", 10, 1.0)
    return ro.predict_readout(v, "vec", w).select("vec_id", "label", "prediction")


@query("m24_forgetting_readout")
def m24(spark, d):
    v = vec(spark, d)
    w = ro.forgetting_readout(v, "vec", DIM, "label", 10, 1.0, 0.999, ["vec_id"])
    return ro.predict_readout(v, "vec", w).select("vec_id", "label", "prediction")


@query("m25_reservoir_features")
def m25(spark, d):
    w = wn.window_arrays(sig(spark, d).withColumn("value", F.col("value") / 100), KEYS, ORDER, ["value"], 8, 4, label="label")
    out = ro.reservoir_features(w, "features", 1, units=16, washout=2)
    return out.select(*KEYS, "window_id", "label", F.transform("features", lambda x: F.round(x, 6)).alias("features"))


@query("m25_sensor_reservoirs")
def m25b(spark, d):
    """Windows of a session's views, clicks and purchases by row number, each event type a sensor with a length of its own."""
    s = sig(spark, d).withColumn("value", F.col("value") / 100)
    rank = F.row_number().over(Window.partitionBy(*KEYS).orderBy(*ORDER))
    kept = lambda kind: F.sort_array(F.collect_list(F.when(F.col("event_type") == kind, F.struct("rn", F.array("value").alias("v")))))
    kinds = ("view", "click", "purchase")
    w = s.withColumn("rn", rank).groupBy(*KEYS, F.expr("(rn - 1) div 8").alias("window_id")).agg(*[kept(k).alias(k) for k in kinds])
    w = w.select(*KEYS, "window_id", *[F.col(f"{k}.v").alias(k) for k in kinds])
    out = ro.sensor_reservoirs(w, {k: 1 for k in kinds}, units=8, washout=1)
    return out.select(*KEYS, "window_id", "missing", F.transform("features", lambda x: F.round(x, 6)).alias("features"))


@query("m29_kernel_vote")
def m29(spark, d):
    """Every session's vectors by the landmarks and class means of the other sessions."""
    v = cut_lineage(vec(spark, d))
    out = None
    for fold in range(5):
        _, marks = _centroids(v.where(F.col("session") != fold))
        k = cut_lineage(jn.landmark_kernel(v, "vec", marks))
        part = ro.kernel_vote(k.where(F.col("session") != fold), k.where(F.col("session") == fold), "label", "vec_id")
        out = part if out is None else out.unionByName(part)
    return out


# ---------------------------------------------------------------- streams
def _stream(spark, d):
    """The events table as a file stream, as signal rows with their timestamp."""
    schema = table(spark, d, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).select(
        F.col("user_id").alias("participant"),
        F.floor((F.dayofmonth("ts") - 1) / 11).cast("int").alias("session"),
        "ts",
        (F.unix_millis("ts") - 1_704_067_200_000).cast("double").alias("timestamp"),
        "value",
        "event_type",
        "event_id",
    )


def _run(spark, stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over everything available and read back what it wrote."""
    root = scratch(spark, name)
    q = stream.writeStream.outputMode("append").format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/ckpt").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


@query(
    "x01_majority_smoothing",
    sql(
        """SELECT participant, session, event_id, CAST(avg(CASE WHEN value > 40 THEN 1.0::DOUBLE ELSE 0 END) OVER (PARTITION BY participant, session ORDER BY event_id
 ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) > 0.5 AS INTEGER) AS smoothed FROM sig""",
        SIG,
    ),
)
def x01(spark, d):
    s = _stream(spark, d).withColumn("hit", (F.col("value") > 40).cast("int"))
    return _run(spark, live.smooth_majority(s, KEYS, "event_id", "hit", 5, "ts", ttl="30 days"), "x01")


def _run_latest(spark, stream: DataFrame, name: str, keys) -> DataFrame:
    """Run an aggregating stream in update mode and keep the last state of every key, so that the newest windows come out too."""
    root = scratch(spark, name)

    def put(batch, number):
        batch.withColumn("_batch", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(f"{root}/out/n{number:09d}")

    q = stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{root}/ckpt").trigger(availableNow=True).start()
    q.awaitTermination()
    values = [c for c in stream.columns if c not in keys]
    states = spark.read.schema(T.StructType([*stream.schema, T.StructField("_batch", T.LongType())])).parquet(f"{root}/out/*")
    last = states.groupBy(*keys).agg(F.max_by(F.struct(*values), "_batch").alias("_last"))
    return last.select(*[c if c in keys else F.col(f"_last.{c}").alias(c) for c in stream.columns])


@query(
    "x02_resample_mean_stream",
    sql(
        """SELECT participant, session, CAST(floor(timestamp / 3600000) AS BIGINT) * 3600000 + 1704067200000 AS start_ms, round(avg(value), 6) + 0.0::DOUBLE AS value
FROM sig GROUP BY participant, session, CAST(floor(timestamp / 3600000) AS BIGINT)""",
        SIG,
    ),
)
def x02(spark, d):
    out = _run_latest(spark, live.resample_mean_stream(_stream(spark, d), KEYS, "ts", ["value"], "1 hour", "1 hour"), "x02", [*KEYS, "ts"])
    return out.select(*KEYS, F.unix_millis("ts").alias("start_ms"), r6("value").alias("value"))


@query(
    "x03_sliding_stats_stream",
    sql(
        """WITH k AS (SELECT participant, session, value, unnest([CAST(floor(timestamp / 86400000) AS BIGINT) - 1, CAST(floor(timestamp / 86400000) AS BIGINT)]) AS w FROM sig)
SELECT participant, session, (w * 86400000 + 1704067200000) AS start_ms, count(*) AS n, round(avg(value), 6) AS value_mean, round(stddev_pop(value), 6) AS value_std, min(value) AS value_min, max(value) AS value_max
FROM k GROUP BY participant, session, w HAVING count(*) >= 3""",
        SIG,
    ),
)
def x03(spark, d):
    out = _run_latest(spark, live.sliding_stats(_stream(spark, d), KEYS, "ts", ["value"], "48 hours", "24 hours", need=3, lateness="1 hour"), "x03", [*KEYS, "start"])
    return out.select(
        *KEYS, F.unix_millis("start").alias("start_ms"), "n", r6("value_mean").alias("value_mean"), r6("value_std").alias("value_std"), "value_min", "value_max"
    )


@query("x04_marker_intervals_stream", sql("SELECT participant, session, start + t0 AS start, \"end\" + t0 AS \"end\", label, ord FROM iv", MARKERS, INTERVALS))
def x04(spark, d):
    t = F.col("event_type")
    name = F.when(t == "signup", "start_activity").when(t == "purchase", "end_activity").when(t == "view", "start_fatigue").when(t == "error", "end_fatigue").otherwise("tick")
    s = _stream(spark, d).withColumn("marker", name)
    return _run(spark, live.marker_intervals_stream(s, LABELS, KEYS, "timestamp", "marker", "event_id", "ts", ttl="30 days"), "x04")


def _late_stream(spark, d, name: str) -> DataFrame:
    """The events as a stream of four batches whose rows arrive up to six hours out of order, and a closing row that moves the watermark past them."""
    root = scratch(spark, name)
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).select("user_id", "ts", "value", "event_type", "event_id")
    arrival = F.unix_seconds("ts") + F.pmod(F.hash("event_id"), F.lit(6 * 3600))
    span = e.agg(F.min(arrival).alias("a"), F.max(arrival).alias("b")).first()
    part = F.floor((arrival - span["a"]) * 4 / (span["b"] - span["a"] + 1))
    for k in range(4):
        e.where(part == k).repartition(1).write.parquet(f"{root}/in/b{k}")
    closing = e.agg(F.max("ts").alias("ts")).select(F.lit(-1).cast("bigint").alias("user_id"), (F.col("ts") + F.expr("interval 40 days")).alias("ts"), F.lit(0.0).alias("value"), F.lit("view").alias("event_type"), F.lit(-1).cast("bigint").alias("event_id"))
    closing.write.parquet(f"{root}/in/b4")
    raw = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{root}/in")
    return raw.select(F.col("user_id").alias("participant"), F.floor((F.dayofmonth("ts") - 1) / 11).cast("int").alias("session"), "ts", "value", "event_type", "event_id")


def _run_rocksdb(spark, make, name: str) -> DataFrame:
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    ordered.use_rocksdb(spark)
    try:
        return _run(spark, make(), name).where("participant <> -1")
    finally:
        spark.conf.set(key, before)


@query(
    "x01_majority_in_event_order",
    sql(
        """SELECT participant, session, event_id, CAST(avg(CASE WHEN value > 40 THEN 1.0::DOUBLE ELSE 0 END) OVER (PARTITION BY participant, session ORDER BY timestamp, event_id
 ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) > 0.5 AS INTEGER) AS smoothed FROM sig""",
        SIG,
    ),
)
def x01b(spark, d):
    def make():
        s = _late_stream(spark, d, "x01_late").withColumn("hit", (F.col("value") > 40).cast("int"))
        return ordered.smooth_majority(s, KEYS, "event_id", "hit", 5, "ts", ttl="100 days", lateness="7 hours")

    return _run_rocksdb(spark, make, "x01_ordered")


@query("x04_intervals_in_event_order", sql("SELECT participant, session, start + t0 AS start, \"end\" + t0 AS \"end\", label, ord FROM iv", MARKERS, INTERVALS))
def x04b(spark, d):
    def make():
        t = F.col("event_type")
        name = F.when(t == "signup", "start_activity").when(t == "purchase", "end_activity").when(t == "view", "start_fatigue").when(t == "error", "end_fatigue").otherwise("tick")
        s = _late_stream(spark, d, "x04_late").withColumn("marker", name)
        return ordered.marker_intervals(s, LABELS, KEYS, "marker", "event_id", "ts", ttl="100 days", lateness="7 hours", origin_ms=ORIGIN)

    return _run_rocksdb(spark, make, "x04_ordered")


@query("x05_dedup_stream", sql("SELECT DISTINCT participant, session, CAST(timestamp AS DOUBLE) AS timestamp FROM sig", SIG))
def x05(spark, d):
    s = _stream(spark, d)
    doubled = s.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return _run(spark, live.dedup_stream(doubled, KEYS, "ts", "1 hour"), "x05").select(*KEYS, "timestamp")


