"""Queries over sources, encodings, profiles, sets and sorts (operators S, P, A, U and T)."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import functions as F

from ..constants import MARKER_FILE
from ..dataset import build_dataset
from ..operators import encode as en
from ..operators import profile as pf
from ..operators import sets as st
from ..operators import timeseries as ts
from ..operators import windows as wn
from ..operators.comoments import corr_matrix_wide
from ..session import ensure_checkpoint_dir
from ..sources import sessions as src
from ..sources import sinks, store, tree
from .bindings import DUPES, HOUR, KEYS, MARKERS, NULLABLE, PRED, SIG, dupes, markers, nullable, pred, r6, sensor, sig, sql, table
from .registry import query
from .time_queries import BOUNDS, INTERVALS, LABELS, ORDER, ROWS, TWIN, _interval_table, _wins

QA = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LONG = """lng AS (UNPIVOT (SELECT l_returnflag, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem) ON l_quantity, l_extendedprice, l_discount, l_tax
 INTO NAME "column" VALUE value)"""


def scratch(spark, name: str) -> str:
    """Fresh folder every executor can reach, for data derived from the tables."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _qa(spark, d):
    return table(spark, d, "lineitem").select("l_returnflag", *QA)


# ---------------------------------------------------------------- sources and sinks
_TREES: dict[tuple[str, str], str] = {}


def _tree(spark, d):
    """The events as a session tree of CSV files (clicks as one sensor, start/end markers), written once per run."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _TREES:
        _TREES[key] = _write_tree(spark, d, scratch(spark, "tree"))
    return _TREES[key]


def _write_tree(spark, d, root):
    s = sig(spark, d)
    for stem, rows in (
        ("wrist_hr", s.where("event_type = 'click'").select(*KEYS, F.col("timestamp").alias(" Time_ms "), F.col("value").alias("HR"), "event_id")),
        ("wrist_ibi", s.where("event_type = 'view'").select(*KEYS, F.col("timestamp").alias("Timestamp"), F.col("value").alias(" duration"), "event_id")),
        ("exp_markers", markers(spark, d).select(*KEYS, F.col("timestamp").alias("utcTime"), F.col("marker").alias("eventMarker"), F.col("pos").alias("event_id"))),
    ):
        tree.write(rows, root, stem, rows.columns[2:4], [rows.columns[2], "event_id"])
    return root


@query(
    "s01_read_sessions",
    sql(
        """SELECT CAST(participant AS VARCHAR) AS participant, CAST(session AS VARCHAR) AS session, timestamp, value AS wrist_hr FROM sig
WHERE event_type = 'click' AND (participant, session) IN (SELECT (participant, session) FROM iv)""",
        MARKERS, INTERVALS,
    ),
)
def s01(spark, d):
    root = _tree(spark, d)
    iv = ts.marker_intervals(src.read_markers(spark, root), LABELS, KEYS, "timestamp", "marker", "pos")
    return src.read_sessions(spark, root, iv)["hr"]


BUILD_SQL = """
{streams},
 span AS (SELECT participant, session, any_value(t0) AS t0, min(start) AS a, max("end") AS b, arg_max("end", ord) FILTER (label = 'activity') AS ae,
 arg_max(start, ord) FILTER (label = 'fatigue') AS fs FROM iv GROUP BY ALL),
 rel AS (SELECT u.participant, u.session, {relative} AS timestamp, wrist_hr, ibi, a, b, ae, fs FROM u JOIN span USING (participant, session)),
 cov AS (SELECT r.participant, r.session, r.timestamp, arg_max(i.label, i.ord) AS l FROM rel r JOIN iv i ON r.participant = i.participant AND r.session = i.session
  AND r.timestamp BETWEEN i.start AND i."end" GROUP BY ALL),
 lab AS (SELECT rel.*, coalesce(l, CASE WHEN timestamp > ae AND timestamp < fs THEN 'pre_fatigue' ELSE 'unlabeled' END) AS label
  FROM rel LEFT JOIN cov USING (participant, session, timestamp) WHERE timestamp BETWEEN a AND b),
 fil AS (SELECT participant, session, timestamp, label, coalesce(last_value(wrist_hr IGNORE NULLS) OVER up, first_value(wrist_hr IGNORE NULLS) OVER down) AS wrist_hr,
  coalesce(last_value(ibi IGNORE NULLS) OVER up, first_value(ibi IGNORE NULLS) OVER down) AS ibi FROM lab
  WINDOW up AS (PARTITION BY participant, session ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  down AS (PARTITION BY participant, session ORDER BY timestamp ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT CAST(participant AS VARCHAR) AS participant, CAST(session AS VARCHAR) AS session, timestamp, round(coalesce(wrist_hr, (SELECT quantile_cont(wrist_hr, 0.5) FROM fil)), 6) + 0.0::DOUBLE AS wrist_hr,
 round(coalesce(ibi, (SELECT quantile_cont(ibi, 0.5) FROM fil)), 6) + 0.0::DOUBLE AS ibi,
 CASE label WHEN 'baseline' THEN 0 WHEN 'activity' THEN 1 WHEN 'pre_fatigue' THEN 2 WHEN 'fatigue' THEN 3 ELSE -1 END AS label FROM fil
"""


def _build(spark, d, sync):
    out = build_dataset(spark, _tree(spark, d), sync, LABELS, target_hz=1000.0 / HOUR)
    return out.withColumns({c: r6(c) for c in ("wrist_hr", "ibi")})


@query(
    "build_dataset_no_sync",
    sql(
        BUILD_SQL.format(
            streams="WITH u AS (SELECT participant, session, timestamp, max(value) FILTER (event_type = 'click') AS wrist_hr, max(value) FILTER (event_type = 'view') AS ibi FROM sig WHERE event_type IN ('click', 'view') GROUP BY ALL)",
            relative="u.timestamp - t0",
        ),
        MARKERS, INTERVALS,
    ),
)
def build_no_sync(spark, d):
    return _build(spark, d, False)


@query(
    "build_dataset_sync",
    sql(
        BUILD_SQL.format(
            streams="""WITH o AS (SELECT participant, session, floor((timestamp - t0) / 3600000) * 3600000 AS timestamp, event_type, avg(value) AS v FROM sig JOIN org USING (participant, session)
 WHERE event_type IN ('click', 'view') GROUP BY ALL),
 lo AS (SELECT participant, session, event_type, min(timestamp) AS x, max(timestamp) AS y FROM o GROUP BY ALL),
 g AS (SELECT participant, session, event_type, unnest(generate_series(CAST(x AS BIGINT), CAST(y AS BIGINT), 3600000)) AS timestamp FROM lo),
 f AS (SELECT g.participant, g.session, g.event_type, g.timestamp, v FROM g LEFT JOIN o USING (participant, session, event_type, timestamp)),
 n AS (SELECT h.participant, h.session, h.timestamp, h.v AS wrist_hr, i.v AS ibi, row_number() OVER (PARTITION BY h.participant, h.session, h.timestamp ORDER BY abs(i.timestamp - h.timestamp), i.timestamp) AS k
  FROM (FROM f WHERE event_type = 'click') h LEFT JOIN (FROM f WHERE event_type = 'view') i ON h.participant = i.participant AND h.session = i.session AND abs(i.timestamp - h.timestamp) <= 3600000),
 u AS (SELECT participant, session, CAST(timestamp AS DOUBLE) AS timestamp, wrist_hr, ibi FROM n WHERE k = 1)""",
            relative="u.timestamp",
        ),
        MARKERS, INTERVALS,
    ),
)
def build_sync(spark, d):
    return _build(spark, d, True)


@query(
    "s02_normalize_sensor",
    sql("SELECT DISTINCT participant, session, timestamp, value FROM nul WHERE value IS NOT NULL", NULLABLE),
)
def s02(spark, d):
    n = nullable(spark, d)
    raw = n.unionByName(n.where("event_id % 10 = 0")).select(
        *KEYS, F.col("timestamp").cast("string").alias(" Time_MS "), F.col("value").cast("string").alias(" Val"), F.col("event_id").alias("_pos"), F.lit("x").alias("_path")
    )
    return src.normalize_sensor(raw, {"val": "value", "absent": "absent"}, "any", tie=("_path", "_pos"))


@query(
    "s03_read_sensor_checked",
    sql(
        """WITH k AS (SELECT DISTINCT CAST(participant AS VARCHAR) AS participant, CAST(session AS VARCHAR) AS session FROM sig),
 h AS (SELECT DISTINCT CAST(participant AS VARCHAR) AS participant, CAST(session AS VARCHAR) AS session FROM sig WHERE event_type = 'click')
SELECT participant, session, 'temp' AS sensor, 'missing file' AS warning FROM k UNION ALL SELECT participant, session, 'odd', 'no useful column' FROM k
UNION ALL SELECT participant, session, 'hr', 'missing file' FROM (FROM k EXCEPT FROM h)""",
        SIG,
    ),
)
def s03(spark, d):
    root = _tree(spark, d)
    wanted = {"hr": ("wrist_hr", {"hr": "wrist_hr"}), "temp": ("wrist_temp", {"temp": "temp"}), "odd": ("exp_markers", {"none": "none"})}
    known = src.read_markers(spark, root).select(*KEYS).distinct()
    return src.read_sensor_checked(spark, root, wanted, known)[1]


@query("s04_read_markers", sql("SELECT CAST(participant AS VARCHAR) AS participant, CAST(session AS VARCHAR) AS session, timestamp, marker FROM markers", MARKERS))
def s04(spark, d):
    return src.read_markers(spark, _tree(spark, d)).drop("pos")


@query("s04_stream_markers", sql("SELECT CAST(participant AS VARCHAR) AS participant, CAST(session AS VARCHAR) AS session, timestamp, marker FROM markers", MARKERS))
def s04_stream(spark, d):
    root, out, done = _tree(spark, d), scratch(spark, "markers"), scratch(spark, "progress")
    time.sleep(1.5 * tree.SETTLE / 1e9)  # files that were written just now are not at rest yet
    new = tree.new_rows(spark, root, MARKER_FILE, ["utctime", "eventmarker"], True)
    rows = new.select(*KEYS, F.col("c_utctime").cast("double").alias("timestamp"), F.col("c_eventmarker").alias("marker"))
    rows.writeStream.format("parquet").option("checkpointLocation", done).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(rows.schema).parquet(out)


@query(
    "s05_read_metadata",
    "SELECT CASE WHEN c_custkey < 10 THEN lpad(CAST(c_custkey AS VARCHAR), 2, '0') ELSE CAST(c_custkey AS VARCHAR) END AS participant, c_acctbal AS balance, "
    "CAST(CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE 1 END AS INTEGER) AS gender FROM customer",
)
def s05(spark, d):
    path = scratch(spark, "meta")
    c = table(spark, d, "customer").select(
        F.col("c_custkey").alias("ID"), F.col("c_acctbal").alias(" What is your balance? "), F.when(F.col("c_custkey") % 2 == 0, " Female ").otherwise("MALE").alias("gender ")
    )
    c.write.option("header", True).csv(path)
    out = src.read_metadata(spark, path, {"What is your balance?": "balance"})
    return out.select("participant", F.col("balance").cast("double").alias("balance"), "gender")


@query("s06_write_dataset", sql("SELECT participant, session, timestamp, value, label FROM sig", SIG))
def s06(spark, d):
    path = scratch(spark, "dataset")
    sinks.write_dataset(sig(spark, d), path, [*KEYS, "timestamp"], ["value"], "label")
    back = spark.read.parquet(path)
    return back.select(F.col("participant").cast("long").alias("participant"), "session", "timestamp", "value", "label")


METRICS_SQL = sql(
    """SELECT 'A' AS model, fold, CAST(avg(CASE WHEN y = p THEN 1.0 ELSE 0.0 END) AS DOUBLE) AS f1_macro FROM pred GROUP BY fold
UNION ALL SELECT 'B', fold, 1.0 - CAST(avg(CASE WHEN y = p THEN 1.0 ELSE 0.0 END) AS DOUBLE) FROM pred GROUP BY fold""",
    PRED,
)


def _metric_documents(spark, d):
    """Documents of models A (first version), B and A (second version)."""
    acc = pred(spark, d).groupBy("fold").agg(F.avg(F.when(F.col("y") == F.col("p"), 1.0).otherwise(0.0)).alias("f1"))

    def doc(model, score):
        fold = F.struct(
            F.col("fold"), F.lit("p").alias("participant"), F.lit("s").alias("session"), score.alias("f1_macro"), score.alias("balanced_accuracy")
        )
        row = acc.agg(F.avg(score).alias("mean_f1"), F.stddev_samp(score).alias("std_f1"), F.collect_list(fold).alias("folds"))
        return row.select(
            "mean_f1", "std_f1", F.col("mean_f1").alias("mean_bal_acc"), F.col("std_f1").alias("std_bal_acc"),
            F.create_map(F.lit("alpha"), F.lit("1")).alias("params"), "folds", F.lit(model).alias("model"),
        )

    return doc("A", F.lit(0.0) * F.col("f1")), doc("B", 1 - F.col("f1")), doc("A", F.col("f1"))


@query("s07_upsert_metrics", METRICS_SQL)
def s07(spark, d):
    path = scratch(spark, "metrics")
    for doc in _metric_documents(spark, d):
        sinks.upsert_metrics(path, doc)
    out = sinks.read_metrics(spark, path).select("model", F.explode("folds").alias("f"))
    return out.select("model", "f.fold", "f.f1_macro")


@query("s07_document_store", METRICS_SQL)
def s07_store(spark, d):
    path = scratch(spark, "documents")
    for doc, model, version in zip(_metric_documents(spark, d), "ABA", (0, 0, 1), strict=True):
        store.upsert(doc, path, "model", {model: version})
    out = store.read(spark, path, "model", sinks.METRICS_SCHEMA).select("model", F.explode("folds").alias("f"))
    return out.select("model", "f.fold", "f.f1_macro")


@query(
    "s08_soft_label_bundle",
    sql("SELECT participant, session, window_id, CAST(rn - window_id * 4 AS INTEGER) AS i, CAST(CAST(value AS FLOAT) AS DOUBLE) AS value FROM win", SIG, ROWS, _wins(8, 4)),
)
def s08(spark, d):
    path = scratch(spark, "soft")
    w = wn.window_arrays(sig(spark, d), KEYS, ORDER, ["value"], 8, 4, label="label").withColumnRenamed("features", "window")
    sinks.write_soft_labels(w, path, ["value"])
    back = sinks.read_soft_labels(spark, path, ["value"])
    return back.select(*KEYS, "window_id", F.posexplode("window").alias("i", "x")).select(*KEYS, "window_id", "i", F.col("x")[0].cast("double").alias("value"))


@query(
    "s09_flatten_reports",
    """SELECT event_id, round((k + 77) / 1024.0, 2)::DOUBLE AS flash_kb, round(k / 1024.0, 2)::DOUBLE AS ram_kb, round(k / 1024.0, 2)::DOUBLE AS weights_kb,
 round(k / 1024.0, 2)::DOUBLE AS activations_kb, k + 1 AS macc, k AS n_params, 0.0::DOUBLE AS model_file_size_kb
FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)""",
)
def s09(spark, d):
    k = F.get_json_object("props", "$.k")
    report = F.concat(
        F.lit('{"memory_footprint":{"kernel_flash":77,"weights":'), k, F.lit(',"activations":'), k, F.lit('},"graphs":[{"nodes":[{"macc":'), k,
        F.lit('},{"macc":1},{"id":3}]}],"environment":{"tools":[{"input_model":{"n_params":'), k, F.lit("}}]}}"),
    )
    return src.flatten_reports(table(spark, d, "events").select("event_id", report.alias("json")), "json").drop("json")


def _write_classes(spark, d, root):
    """Label rows as small text files below class folders."""
    rows = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("value"), F.concat(F.lit("c"), "quality").alias("class"))
    rows.repartition(4, "value").write.partitionBy("class").text(root)
    return root


@query("s10_list_labeled_files")
def s10(spark, d):
    return src.list_labeled_files(spark, _write_classes(spark, d, scratch(spark, "classes")), ("txt",)).select("class", "length")


@query(
    "s11_folder_sizes",
    """SELECT 'class=c' || quality AS model, CAST(sum(length(CAST(doc_id AS VARCHAR)) + 1) AS BIGINT) AS bytes, round(sum(length(CAST(doc_id AS VARCHAR)) + 1) / 1048576.0, 2)::DOUBLE AS size_mb,
 round(sum(length(CAST(doc_id AS VARCHAR)) + 1) / 1024.0, 2)::DOUBLE AS size_kb FROM labels GROUP BY quality""",
)
def s11(spark, d):
    return src.folder_sizes(spark, _write_classes(spark, d, scratch(spark, "classes"))).drop("n_files")


@query(
    "s12_load_slice",
    sql("SELECT participant, session, timestamp, value, CAST(NULL AS DOUBLE) AS temp FROM sig WHERE participant = 8 AND session = 1", SIG),
)
def s12(spark, d):
    out, _ = src.load_slice(sig(spark, d).select(*KEYS, "timestamp", "value"), {"participant": 8, "session": 1}, ["value", "temp"])
    return out


@query(
    "s13_wide_to_sensors",
    sql(
        """SELECT participant, session, timestamp, event_type AS sensor, value, 0.0::DOUBLE AS missing FROM sig WHERE event_type IN ('click', 'view')""",
        SIG,
    ),
)
def s13(spark, d):
    from ..operators.joins import fuse_sensors_outer

    wide = fuse_sensors_outer([sensor(spark, d, "click"), sensor(spark, d, "view")], KEYS, "timestamp")
    parts = src.wide_to_sensors(wide, {"click": ["click_value"], "view": ["view_value"]}, KEYS, "timestamp")
    rows = [
        p.select(*KEYS, "timestamp", F.lit(n).alias("sensor"), F.col(f"{n}_value").alias("value"), F.col(f"{n}_value_missing").alias("missing")) for n, p in parts.items()
    ]
    return rows[0].unionByName(rows[1])


# ---------------------------------------------------------------- encodings
@query("p01_project_map", sql("SELECT participant, value AS hr FROM sig", SIG))
def p01(spark, d):
    return en.project_map(sig(spark, d), {"value": "hr", "absent": "x"}, keep=["participant"])


@query("p02_coerce_numeric", "SELECT event_id, TRY_CAST(CASE WHEN event_id % 3 = 0 THEN event_type ELSE CAST(user_id AS VARCHAR) END AS DOUBLE) AS x FROM events")
def p02(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.col("user_id").cast("string")).alias("x"))
    return en.coerce_numeric(e, ["x"])


@query("p03_pad_key", "SELECT c_custkey, CASE WHEN length(CAST(c_custkey AS VARCHAR)) < 3 THEN lpad(CAST(c_custkey AS VARCHAR), 3, '0') ELSE CAST(c_custkey AS VARCHAR) END AS key FROM customer")
def p03(spark, d):
    from ..functions.text import pad_key

    return table(spark, d, "customer").select("c_custkey", pad_key(F.col("c_custkey"), 3).alias("key"))


@query(
    "p04_encode_ordinal",
    "SELECT c_custkey, CAST(CASE lower(c_mktsegment) WHEN 'household' THEN 1 WHEN 'machinery' THEN 2 WHEN 'building' THEN 3 END AS INTEGER) AS segment FROM customer",
)
def p04(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.concat(F.lit(" "), "c_mktsegment").alias("segment"))
    return en.encode_ordinal(c, {"segment": {"household": 1, "machinery": 2, "building": 3}, "absent": {"a": 1}})


@query(
    "p05_encode_labels",
    sql(
        """SELECT event_id, CAST(CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 3 WHEN 'error' THEN -1 END AS TINYINT) AS label
FROM sig WHERE event_type <> 'signup'""",
        SIG,
    ),
)
def p05(spark, d):
    t = sig(spark, d).select("event_id", F.when(F.col("event_type") == "error", "unlabeled").otherwise(F.col("event_type")).alias("label"))
    return en.encode_labels(t, "label", {"view": 0, "click": 1, "purchase": 3})


@query(
    "p06_split_labeled",
    sql("SELECT event_id, CAST(CASE WHEN event_id % 5 = 0 OR label < 0 THEN -1 ELSE label END AS INTEGER) AS label, NOT (event_id % 5 = 0 OR label < 0) AS labeled FROM sig", SIG),
)
def p06(spark, d):
    t = sig(spark, d).select("event_id", F.when(F.col("event_id") % 5 == 0, "none").otherwise(F.col("label").cast("string")).alias("label"))
    a, b = en.split_labeled(t, "label")
    return a.withColumn("labeled", F.lit(True)).unionByName(b.withColumn("labeled", F.lit(False)))


@query("p07_log1p", sql("SELECT event_id, round(ln(1 + greatest(value - 20, 0)), 6) AS value FROM sig", SIG))
def p07(spark, d):
    s = sig(spark, d).select("event_id", (F.col("value") - 20).alias("value"))
    return en.log1p_cols(s, ["value"], clip=True).withColumn("value", r6("value"))


@query("p07_skew_report", sql("SELECT 'value' AS \"column\", round(skewness(value), 6) AS before, round(skewness(ln(1 + value)), 6) AS after FROM sig", SIG))
def p07b(spark, d):
    return en.skew_report(sig(spark, d), ["value"]).withColumns({"before": r6("before"), "after": r6("after")})


@query("p08_drop_if_exists", sql("SELECT participant, session, timestamp, value, label FROM sig", SIG))
def p08(spark, d):
    return en.drop_if_exists(sig(spark, d), "event_id", "event_type", "breathing_q")


@query("p09_reduce_precision", sql("SELECT event_id, CAST(CAST(value AS FLOAT) AS DOUBLE) AS value, CAST(label AS TINYINT) AS label FROM sig", SIG))
def p09(spark, d):
    out = en.reduce_precision(sig(spark, d).select("event_id", "value", "label"), ["value"], "label")
    return out.withColumn("value", F.col("value").cast("double"))


@query("p09_precision_report", sql("SELECT count(*) * 8 AS bytes_before, count(*) * 4 AS bytes_after FROM sig", SIG))
def p09b(spark, d):
    return en.precision_report(sig(spark, d), ["value"])


@query(
    "p10_relative_time",
    sql("SELECT event_id, participant, session, timestamp - min(timestamp) OVER (PARTITION BY participant, session) AS timestamp FROM sig", SIG),
)
def p10(spark, d):
    s = sig(spark, d).select("event_id", *KEYS, "timestamp")
    return en.relative_time(s, en.session_origin([markers(spark, d), s], KEYS, "timestamp"), KEYS, "timestamp")


@query(
    "p11_to_seconds_auto",
    sql(
        """WITH x AS (SELECT event_id, participant, session, CASE WHEN participant % 2 = 0 THEN timestamp ELSE floor(timestamp / 1e6) END AS t FROM sig),
 s AS (SELECT participant, session, t - lag(t) OVER (PARTITION BY participant, session ORDER BY t, event_id) AS st FROM x),
 m AS (SELECT participant, session, quantile_cont(st, 0.5) AS med FROM s WHERE st > 0 GROUP BY ALL), b AS (SELECT participant, session, min(t) AS lo, max(t) AS hi FROM x GROUP BY ALL)
SELECT event_id, participant, session, t AS timestamp, round(CASE WHEN coalesce(med, 0) > 10 OR hi > 10000 THEN (t - lo) / 1000 ELSE t - lo END, 6) AS seconds
FROM x JOIN b USING (participant, session) LEFT JOIN m USING (participant, session)""",
        SIG,
    ),
)
def p11(spark, d):
    s = sig(spark, d).select(
        "event_id", *KEYS, F.when(F.col("participant") % 2 == 0, F.col("timestamp")).otherwise(F.floor(F.col("timestamp") / 1e6).cast("double")).alias("timestamp")
    )
    return en.to_seconds_auto(s, KEYS, "timestamp").withColumn("seconds", r6("seconds"))


@query(
    "p12_clip_to_session",
    sql(
        """WITH b AS (SELECT participant, session, min(start) AS s, max("end") AS e, any_value(t0) AS t0 FROM iv GROUP BY ALL)
SELECT event_id, participant, session, timestamp - t0 AS timestamp FROM sig JOIN b USING (participant, session) WHERE timestamp - t0 BETWEEN s AND e""",
        MARKERS, INTERVALS,
    ),
)
def p12(spark, d):
    iv = _interval_table(spark, d)
    s = en.relative_time(sig(spark, d).select("event_id", *KEYS, "timestamp"), iv.select(*KEYS, "t0").distinct(), KEYS, "timestamp")
    return en.clip_to_session(s, iv, KEYS, "timestamp")


@query("p13_split_cohort", sql("SELECT event_id, participant IN (1, 5, 9) AS atypical FROM sig", SIG))
def p13(spark, d):
    a, b = en.split_cohort(sig(spark, d).select("event_id", "participant"), "participant", [1, 5, 9])
    return a.select("event_id", F.lit(False).alias("atypical")).unionByName(b.select("event_id", F.lit(True).alias("atypical")))


@query("p14_blank_keys", sql("SELECT DISTINCT participant FROM sig WHERE event_id % 50 = 0", SIG))
def p14(spark, d):
    s = sig(spark, d).withColumn("text", F.when(F.col("event_id") % 50 == 0, "  ").otherwise(F.col("event_type")))
    return en.blank_keys(s, "text", ["participant"])


@query(
    "p15_sanitize",
    sql("SELECT event_id, CAST(CASE WHEN event_id % 7 = 0 THEN 0 WHEN event_id % 11 = 0 THEN -8 ELSE greatest(-8, least(8, value - 30)) END AS DOUBLE) AS value FROM sig", SIG),
)
def p15(spark, d):
    v = F.when(F.col("event_id") % 7 == 0, float("nan")).when(F.col("event_id") % 11 == 0, float("-inf")).otherwise(F.col("value") - 30)
    return en.sanitize(sig(spark, d).select("event_id", v.alias("value")), ["value"], 8.0)


@query(
    "p16_minmax",
    "SELECT l_orderkey, l_linenumber, round((l_quantity - (SELECT min(l_quantity) FROM lineitem)) / (SELECT max(l_quantity) - min(l_quantity) FROM lineitem), 6) AS l_quantity, "
    "round((l_extendedprice - (SELECT min(l_extendedprice) FROM lineitem)) / (SELECT max(l_extendedprice) - min(l_extendedprice) FROM lineitem), 6) AS l_extendedprice, 0.5::DOUBLE AS flat FROM lineitem",
)
def p16(spark, d):
    q = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", F.lit(5.0).alias("flat"))
    out = en.minmax(q, ["l_quantity", "l_extendedprice", "flat"])
    return out.withColumns({c: r6(c) for c in ("l_quantity", "l_extendedprice")})


@query(
    "p17_minmax_shared",
    """WITH v AS (SELECT 'orders' AS src, o_orderkey AS id, o_totalprice AS price FROM orders UNION ALL SELECT 'part', p_partkey, p_retailprice FROM part)
SELECT src, id, round((price - (SELECT min(price) FROM v)) / (SELECT max(price) - min(price) FROM v), 6) AS price FROM v""",
)
def p17(spark, d):
    a = table(spark, d, "orders").select(F.lit("orders").alias("src"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    b = table(spark, d, "part").select(F.lit("part").alias("src"), F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("price"))
    a, b = en.minmax_shared([a, b], ["price"])
    return a.unionByName(b).withColumn("price", r6("price"))


@query("p18_between", sql("SELECT event_id, value FROM sig WHERE value BETWEEN 3 AND 60", SIG))
def p18(spark, d):
    return en.between_filter(sig(spark, d).select("event_id", "value"), "value", 3, 60)


@query(
    "p19_label_names",
    sql("SELECT event_id, CASE label WHEN 0 THEN 'baseline' WHEN 1 THEN 'activity' WHEN 2 THEN 'pre_fatigue' WHEN 3 THEN 'fatigue' ELSE 'unlabeled' END AS label_name FROM sig", SIG),
)
def p19(spark, d):
    return en.label_names(sig(spark, d), "label").select("event_id", "label_name")


@query(
    "p20_one_hot",
    "SELECT c_custkey, " + ", ".join(f"CAST(c_mktsegment = '{s}' AS INTEGER) AS \"c_mktsegment_{s}\"" for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " FROM customer",
)
def p20(spark, d):
    c = table(spark, d, "customer")
    return en.one_hot(c, "c_mktsegment", en.categories(c, "c_mktsegment")).drop("c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


# ---------------------------------------------------------------- profile
@query("a01_overview", "SELECT count(*) AS n_rows, 5 AS n_columns, CAST(sum(32 + length(l_returnflag)) AS BIGINT) AS size_bytes, unnest(['double', 'string']) AS type, unnest([4, 1]) AS n_of_type FROM lineitem")
def a01(spark, d):
    return pf.profile_overview(_qa(spark, d))


@query(
    "a01_head_tail",
    sql("SELECT event_id, value, 'head' AS part FROM (FROM sig ORDER BY event_id LIMIT 5) UNION ALL SELECT event_id, value, 'tail' FROM (FROM sig ORDER BY event_id DESC LIMIT 5)", SIG),
)
def a01b(spark, d):
    return pf.head_tail(sig(spark, d).select("event_id", "value"), ["event_id"])


@query(
    "a02_missing",
    sql(
        """WITH c AS (SELECT count(*) AS n, count(*) FILTER (value IS NULL OR label IS NULL) AS r, count(*) FILTER (value IS NULL) AS v, count(*) FILTER (label IS NULL) AS l
 FROM (SELECT value, CASE WHEN event_id % 9 <> 0 THEN label END AS label FROM nul))
SELECT r AS rows_with_missing, v + l AS total_missing, 'value' AS "column", v AS n_missing, round(v / n * 100, 2) AS percent FROM c
UNION ALL SELECT r, v + l, 'label', l, round(l / n * 100, 2) FROM c""",
        NULLABLE,
    ),
)
def a02(spark, d):
    return pf.profile_missing(nullable(spark, d).select("value", F.when(F.col("event_id") % 9 != 0, F.col("label")).alias("label")))


@query(
    "a03_duplicates",
    sql(
        """WITH e AS (SELECT sum(c) AS n, sum(c - 1) AS x FROM (SELECT count(*) AS c FROM dup GROUP BY participant, session, timestamp, value, label, event_id, event_type)),
 t AS (SELECT sum(c - 1) AS b, sum(CASE WHEN c > 1 THEN c ELSE 0 END) AS i FROM (SELECT count(*) AS c FROM dup GROUP BY timestamp))
SELECT CAST(n AS BIGINT) AS n_rows, CAST(x AS BIGINT) AS exact, CAST(b AS BIGINT) AS by_time, CAST(i AS BIGINT) AS rows_involved, round(x / n * 100, 6) AS exact_percent, round(b / n * 100, 6) AS time_percent FROM e, t""",
        DUPES,
    ),
)
def a03(spark, d):
    return pf.profile_duplicates(dupes(spark, d), "timestamp").withColumns({c: r6(c) for c in ("exact_percent", "time_percent")})


@query(
    "a03_duplicates_by_group",
    sql("SELECT participant, session, count(*) - count(DISTINCT event_id) AS n_duplicates FROM dup GROUP BY ALL HAVING count(*) > count(DISTINCT event_id)", DUPES),
)
def a03b(spark, d):
    return pf.duplicates_by_group(dupes(spark, d), KEYS)


STATS_SQL = """SELECT "column", count(*) AS count, round(avg(value), 3) AS mean, round(stddev_samp(value), 3) AS std, round(min(value), 3) AS min, round(quantile_cont(value, 0.25), 3) AS q25,
 round(quantile_cont(value, 0.5), 3) AS median, round(quantile_cont(value, 0.75), 3) AS q75, round(max(value), 3) AS max, round(skewness(value), 3) AS skewness, round(kurtosis(value), 3) AS kurtosis
FROM lng GROUP BY "column\""""


@query("a04_describe", sql(STATS_SQL, LONG))
def a04(spark, d):
    return pf.profile_stats(_qa(spark, d), QA)


@query(
    "a05_labels",
    sql(
        """WITH c AS (SELECT label, count(*) AS n, count(*) * 100.0::DOUBLE / sum(count(*)) OVER () AS p FROM sig GROUP BY label)
SELECT label, n, round(p, 2) AS percent, max(p) OVER () - min(p) OVER () < 10 AS balanced FROM c""",
        SIG,
    ),
)
def a05(spark, d):
    return pf.profile_labels(sig(spark, d), "label")


@query("a06_participants", sql("SELECT participant, count(*) AS n, count(DISTINCT session) AS n_sessions FROM sig GROUP BY participant", SIG))
def a06(spark, d):
    return pf.profile_participants(sig(spark, d), *KEYS)


@query(
    "a07_sessions",
    sql("SELECT participant, session, count(*) AS n, count(*) FILTER (label = -1) AS unlabeled, count(*) FILTER (label = 0) AS baseline, count(*) FILTER (label = 3) AS fatigue FROM sig GROUP BY ALL", SIG),
)
def a07(spark, d):
    out = pf.profile_sessions(sig(spark, d), KEYS, "label")

    def pick(code):
        return F.coalesce(F.try_element_at("labels", F.lit(code)), F.lit(0))

    return out.select(*KEYS, "n", pick(-1).alias("unlabeled"), pick(0).alias("baseline"), pick(3).alias("fatigue"))


STEPS = """st AS (SELECT * FROM (SELECT participant, session, timestamp - lag(timestamp) OVER (PARTITION BY participant, session ORDER BY timestamp) AS step FROM sig) WHERE step > 0)"""


@query(
    "a08_continuity",
    sql(
        "SELECT participant, session, round(avg(step), 6) AS mean_step, min(step) AS min_step, max(step) AS max_step, count(*) FILTER (step > 72000000) AS n_jumps FROM st GROUP BY participant, session",
        SIG, STEPS,
    ),
)
def a08(spark, d):
    return pf.profile_continuity(sig(spark, d), KEYS, "timestamp", 10 * HOUR).withColumn("mean_step", r6("mean_step"))


@query(
    "a09_outliers",
    sql(
        """WITH q AS (SELECT "column", quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM lng GROUP BY "column")
SELECT "column", count(*) FILTER (value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)) AS n_outliers, count(*) AS n, min(value) AS min, max(value) AS max,
 round(count(*) FILTER (value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)) / count(*) * 100, 6) AS percent FROM lng JOIN q USING ("column") GROUP BY "column\"""",
        LONG,
    ),
)
def a09(spark, d):
    return pf.profile_outliers(_qa(spark, d), QA).withColumn("percent", r6("percent"))


@query(
    "a10_correlation",
    " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 3) + 0.0::DOUBLE AS r FROM lineitem" for i, a in enumerate(QA) for b in QA[:i]),
)
def a10(spark, d):
    return pf.corr_matrix(_qa(spark, d), QA).withColumn("r", F.col("r") + F.lit(0.0))


@query(
    "a10_correlation_wide",
    """WITH lng AS (SELECT vec_id, j, CAST(embedding[j + 1] AS DOUBLE) AS v FROM (SELECT vec_id, embedding, unnest(range(0, len(embedding))) AS j FROM embeddings)
 WHERE (vec_id + j) % 5 <> 0)
SELECT concat('e', x.j) AS a, concat('e', y.j) AS b, round(corr(x.v, y.v), 3) + 0.0::DOUBLE AS r FROM lng x JOIN lng y USING (vec_id) WHERE y.j < x.j GROUP BY x.j, y.j""",
)
def a10_wide(spark, d):
    e = table(spark, d, "embeddings")
    width = e.agg(F.max(F.size("embedding"))).first()[0] or 0
    cols = [f"e{j}" for j in range(width)]
    wide = e.select(*[F.when((F.col("vec_id") + j) % 5 != 0, F.get("embedding", F.lit(j))).alias(c) for j, c in enumerate(cols)])
    return corr_matrix_wide(wide, cols).withColumn("r", F.col("r") + F.lit(0.0))


@query(
    "a11_stats_by_label",
    sql(
        """SELECT l_returnflag, "column", round(avg(value), 3) AS mean, round(stddev_samp(value), 3) AS std, round(min(value), 3) AS min, round(max(value), 3) AS max FROM lng GROUP BY ALL""",
        LONG,
    ),
)
def a11(spark, d):
    return pf.stats_by_label(_qa(spark, d), "l_returnflag", QA)


@query(
    "a12_time",
    sql(
        "SELECT min(timestamp) AS min_ms, max(timestamp) AS max_ms, round((max(timestamp) - min(timestamp)) / 3600000, 2) AS hours, CAST(min(timestamp) AS BIGINT) AS min_time, CAST(max(timestamp) AS BIGINT) AS max_time FROM sig",
        SIG,
    ),
)
def a12(spark, d):
    out = pf.profile_time(sig(spark, d), "timestamp")
    return out.withColumns({c: F.unix_millis(c) for c in ("min_time", "max_time")})


@query(
    "a13_summary",
    sql(
        """WITH c AS (SELECT count(*) AS n, count(DISTINCT participant) AS p, count(DISTINCT session) AS s, count(*) - count(DISTINCT event_id) AS e, count(*) - count(DISTINCT timestamp) AS t FROM dup),
 b AS (SELECT max(x) - min(x) < 10 AS b FROM (SELECT count(*) * 100.0 / sum(count(*)) OVER () AS x FROM dup GROUP BY label))
SELECT unnest(['rows', 'participants', 'sessions', 'signals', 'duplicates', 'duplicate_stamps', 'missing', 'balanced']) AS "check",
 unnest([n, p, s, 1, e, t, 0, CAST(b AS BIGINT)]) AS value, unnest([true, true, true, true, e = 0, t = 0, true, b]) AS ok FROM c, b""",
        DUPES,
    ),
)
def a13(spark, d):
    return pf.profile_summary(dupes(spark, d), *KEYS, "timestamp", "label", 1)


@query(
    "a14_support_pivot",
    sql("SELECT participant, count(*) FILTER (label = -1) AS label_m1, count(*) FILTER (label = 0) AS label_0, count(*) FILTER (label = 1) AS label_1, count(*) FILTER (label = 2) AS label_2, count(*) FILTER (label = 3) AS label_3 FROM sig GROUP BY ALL", SIG),
)
def a14(spark, d):
    return pf.support_pivot(sig(spark, d), "participant", "label", [-1, 0, 1, 2, 3])


@query("a15_label_counts", sql("SELECT participant, session, label, count(*) AS n FROM sig GROUP BY ALL", SIG))
def a15(spark, d):
    return pf.label_counts_by_session(sig(spark, d), KEYS, "label")


@query("a16_participant_profile", sql("SELECT participant, round(coalesce(avg(value), 0), 9) AS value_mean, round(coalesce(stddev_samp(value), 0), 6) AS value_std FROM sig GROUP BY participant", SIG))
def a16(spark, d):
    out = pf.participant_profile(sig(spark, d), "participant", ["value"])
    return out.select("participant", F.round("value_mean", 9).alias("value_mean"), r6("value_std").alias("value_std"))


@query(
    "a17_median_by_label",
    "SELECT l_returnflag, " + ", ".join(f"round(quantile_cont({c}, 0.5), 6) AS {c}_median" for c in QA) + " FROM lineitem GROUP BY l_returnflag",
)
def a17(spark, d):
    out = pf.median_by_label(_qa(spark, d), "l_returnflag", QA)
    return out.withColumns({f"{c}_median": r6(f"{c}_median") for c in QA})


@query(
    "a18_box_stats",
    sql(
        """WITH q AS (SELECT l_returnflag, "column", quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.75) AS b FROM lng GROUP BY ALL)
SELECT l_returnflag, "column", round(any_value(a), 6) AS q1, round(any_value(m), 6) AS median, round(any_value(b), 6) AS q3,
 min(value) FILTER (value BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)) AS whisker_low, max(value) FILTER (value BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)) AS whisker_high,
 count(*) FILTER (NOT value BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)) AS n_fliers FROM lng JOIN q USING (l_returnflag, "column") GROUP BY l_returnflag, "column\"""",
        LONG,
    ),
)
def a18(spark, d):
    return pf.box_stats(_qa(spark, d), ["l_returnflag"], QA).withColumns({c: r6(c) for c in ("q1", "median", "q3")})


@query("a19_means", "SELECT l_returnflag, " + ", ".join(f"round(avg({c}), 6) AS {c}_mean" for c in QA) + " FROM lineitem GROUP BY l_returnflag")
def a19(spark, d):
    out = pf.means_by(_qa(spark, d), ["l_returnflag"], QA)
    return out.select("l_returnflag", *[r6(f"{c}_mean").alias(f"{c}_mean") for c in QA])


@query(
    "a20_freq_mean",
    sql("SELECT participant, session, round(CASE WHEN count(*) > 1 THEN (count(*) - 1) * 1000.0::DOUBLE / (max(timestamp) - min(timestamp)) END, 9) AS hz FROM sig GROUP BY ALL", SIG),
)
def a20(spark, d):
    return pf.freq_mean(sig(spark, d), KEYS, "timestamp").withColumn("hz", F.round("hz", 9))


@query(
    "a21_freq_median",
    sql("SELECT participant, session, round(hz, 9) AS hz FROM (SELECT DISTINCT participant, session FROM sig) LEFT JOIN (SELECT participant, session, 1000 / quantile_cont(step, 0.5) AS hz FROM st GROUP BY ALL) USING (participant, session)", SIG, STEPS),
)
def a21(spark, d):
    return pf.freq_median(sig(spark, d), KEYS, "timestamp").withColumn("hz", F.round("hz", 9))


PHASES = """fm AS (SELECT participant, session, arg_min(timestamp, pos) FILTER (marker = 'start_activity') AS sa, arg_min(timestamp, pos) FILTER (marker = 'end_activity') AS ea,
 arg_min(timestamp, pos) FILTER (marker = 'start_fatigue') AS sf, arg_min(timestamp, pos) FILTER (marker = 'end_fatigue') AS ef,
 arg_min(timestamp, pos) FILTER (marker = 'start_baseline') AS sb, arg_min(timestamp, pos) FILTER (marker = 'end_baseline') AS eb, max(timestamp) AS se FROM mk GROUP BY ALL),
 ph AS (SELECT *, coalesce(greatest(0, eb - sb), 0) AS b, coalesce(greatest(0, ea - sa), 0) AS a, coalesce(greatest(0, sf - ea), 0) AS p, coalesce(greatest(0, ef - sf), 0) AS f,
 CASE WHEN eb - sb IS NULL THEN 0 ELSE greatest(0, eb - sb) END AS b0, CASE WHEN ea - sa IS NULL THEN 0 ELSE greatest(0, ea - sa) END AS a0,
 CASE WHEN sf - ea IS NULL THEN 0 ELSE greatest(0, sf - ea) END AS p0, CASE WHEN ef - sf IS NULL THEN 0 ELSE greatest(0, ef - sf) END AS f0 FROM fm)"""
PLAIN = "mk AS (SELECT * FROM markers)"
SIX = """mk AS (SELECT participant, session, timestamp, pos, CASE WHEN marker = 'tick' AND pos % 2 = 0 THEN 'start_baseline' WHEN marker = 'tick' THEN 'end_baseline' ELSE marker END AS marker FROM markers)"""


@query(
    "a22_phase_durations",
    sql(
        """WITH s AS (SELECT sum(b0) AS b, sum(a0) AS a, sum(p0) AS p, sum(f0) AS f FROM ph)
SELECT unnest(['baseline', 'activity', 'pre_fatigue', 'fatigue']) AS phase, unnest([b, a, p, f])::DOUBLE AS duration, round(unnest([b, a, p, f])::DOUBLE / (b + a + p + f) * 100, 6) AS percent FROM s""",
        MARKERS, SIX, PHASES,
    ),
)
def a22(spark, d):
    return pf.phase_durations(_six(spark, d), KEYS, "timestamp", "marker", "pos").withColumn("percent", r6("percent"))


def _six(spark, d):
    """Markers with the neutral events standing in for baseline starts and ends."""
    m = markers(spark, d)
    name = F.when((F.col("marker") == "tick") & (F.col("pos") % 2 == 0), "start_baseline").when(F.col("marker") == "tick", "end_baseline")
    return m.withColumn("marker", F.coalesce(name, F.col("marker")))


@query(
    "a23_training_usage",
    sql(
        """WITH r AS (SELECT greatest(0, se - sb) AS t, b0 + a0 + p0 + f0 AS u, greatest(0, sa - eb) + greatest(0, se - ef) AS n FROM ph
 WHERE sb IS NOT NULL AND eb IS NOT NULL AND sa IS NOT NULL AND ea IS NOT NULL AND sf IS NOT NULL AND ef IS NOT NULL)
SELECT sum(t) AS total, sum(u) AS used, sum(n) AS unused, count(*) AS n_sessions, round(sum(u) / sum(t) * 100, 6) AS used_percent, round(sum(n) / sum(t) * 100, 6) AS unused_percent FROM r""",
        MARKERS, SIX, PHASES,
    ),
)
def a23(spark, d):
    m = _six(spark, d)
    ends = m.groupBy(*KEYS).agg(F.max("timestamp").alias("session_end"))
    out = pf.training_usage(m, ends, KEYS, "timestamp", "marker", "pos")
    return out.withColumns({c: r6(c) for c in ("used_percent", "unused_percent")})


@query(
    "a24_session_bounds",
    sql(
        """WITH m AS (SELECT participant, session, min(timestamp) AS a, min(timestamp) FILTER (marker = 'end_fatigue') AS e FROM markers GROUP BY ALL),
 s AS (SELECT participant, session, min(timestamp) AS a, max(timestamp) AS b FROM sig WHERE event_type = 'click' GROUP BY ALL)
SELECT participant, session, least(m.a, s.a) AS start, coalesce(m.e, s.b) AS "end" FROM m FULL JOIN s USING (participant, session)""",
        MARKERS,
    ),
)
def a24(spark, d):
    return pf.session_bounds(sensor(spark, d, "click"), markers(spark, d), KEYS, "timestamp", "marker", "end_fatigue")


@query(
    "a24_label_overlap",
    sql(
        """SELECT s.participant, s.session, count(DISTINCT s.event_id) AS rows_inside FROM sig s JOIN iv i ON s.participant = i.participant AND s.session = i.session
 AND s.timestamp - i.t0 BETWEEN i.start AND i."end" GROUP BY ALL""",
        MARKERS, INTERVALS,
    ),
)
def a24b(spark, d):
    iv = _interval_table(spark, d)
    rows = en.relative_time(sig(spark, d), iv.select(*KEYS, "t0").distinct(), KEYS, "timestamp").drop("label")
    return pf.overlap_rows(rows, iv, LABELS, KEYS, "timestamp")


@query("a25_class_weights", sql("SELECT label, count(*) AS n, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6)::DOUBLE AS weight FROM sig GROUP BY label", SIG))
def a25(spark, d):
    return pf.class_weights(sig(spark, d), "label").withColumn("weight", r6("weight"))


@query(
    "a26_majority_label",
    sql(
        """SELECT participant, session, label FROM (SELECT participant, session, label, row_number() OVER (PARTITION BY participant, session ORDER BY count(*) DESC, label) AS k
 FROM sig GROUP BY participant, session, label) WHERE k = 1""",
        SIG,
    ),
)
def a26(spark, d):
    return sig(spark, d).groupBy(*KEYS).agg(wn.majority("label").alias("label"))


@query(
    "a27_summarize_folds",
    sql(
        """WITH f AS (SELECT fold, avg(CASE WHEN y = p THEN 1.0::DOUBLE ELSE 0 END) AS acc FROM pred GROUP BY fold)
SELECT 'toxic' AS model, count(*) AS n_folds, round(avg(acc), 6) AS acc_mean, round(stddev_samp(acc), 6) AS acc_std, round(min(acc), 6) AS acc_min, round(max(acc), 6) AS acc_max FROM f""",
        PRED,
    ),
)
def a27(spark, d):
    f = pred(spark, d).groupBy("fold").agg(F.avg(F.when(F.col("y") == F.col("p"), 1.0).otherwise(0.0)).alias("acc")).withColumn("model", F.lit("toxic"))
    out = pf.summarize_folds(f, ["model"], ["acc"])
    return out.withColumns({f"acc_{s}": r6(f"acc_{s}") for s in ("mean", "std", "min", "max")})


@query(
    "a28_median_step",
    sql("SELECT participant, session, round(coalesce(m, 0), 6) AS median_step FROM (SELECT DISTINCT participant, session FROM sig) LEFT JOIN (SELECT participant, session, quantile_cont(step, 0.5) AS m FROM st GROUP BY ALL) USING (participant, session)", SIG, STEPS),
)
def a28(spark, d):
    return pf.median_step(sig(spark, d), KEYS, "timestamp").withColumn("median_step", r6("median_step"))


@query("a29_median_fill", sql("SELECT event_id, round(coalesce(value, (SELECT quantile_cont(value, 0.5) FROM nul)), 6) AS value FROM nul", NULLABLE))
def a29(spark, d):
    from ..operators.quantile import medians

    n = nullable(spark, d).select("event_id", "value")
    return n.fillna(medians(n, ["value"])).withColumn("value", r6("value"))


@query(
    "a30_coverage",
    sql(
        """SELECT tw.participant, tw.session, tw.window_id, count(*) AS n, count(*) >= 3 AS covered FROM tw JOIN sig s ON s.participant = tw.participant AND s.session = tw.session
 AND s.timestamp >= tw.start AND s.timestamp < tw."end" WHERE s.event_type = 'click' GROUP BY ALL""",
        SIG, BOUNDS, TWIN,
    ),
)
def a30(spark, d):
    s = sig(spark, d)
    b = s.groupBy(*KEYS).agg(F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"))
    rows = wn.covering_windows(sensor(spark, d, "click").join(b, KEYS), "timestamp", "lo", "hi", 48 * HOUR, 24 * HOUR)
    need = wn.min_samples(1 / 21_600, 172_800, 0.35)  # one click per six hours expected: 8 x 0.35 rounds to 3
    return pf.has_coverage(rows, [*KEYS, "window_id"], need)


@query("a31_remove_duplicates", sql("SELECT participant, session, timestamp, value, label, event_id, event_type FROM sig", SIG))
def a31(spark, d):
    return pf.remove_duplicates(dupes(spark, d), [*KEYS, "timestamp"], "event_id")


@query("a31_remove_all_repeats", sql("SELECT participant, session, timestamp, value, label, event_id, event_type FROM sig WHERE event_id % 10 <> 0", SIG))
def a31b(spark, d):
    return pf.remove_duplicates(dupes(spark, d), [*KEYS, "timestamp"], "event_id", keep="none")


# ---------------------------------------------------------------- text, time, sets, sorts
@query(
    "f18_text_helpers",
    "SELECT event_id, upper(event_type) AS trimmed, contains(event_type, 'e') AS has_e, 'P' || CASE WHEN user_id < 10 THEN '0' ELSE '' END || CAST(user_id AS VARCHAR) AS id FROM events",
)
def f18(spark, d):
    from ..functions import text as tx

    e = table(spark, d, "events")
    return e.select(
        "event_id", F.upper(tx.clean(F.concat(F.lit("  "), F.upper("event_type")))).alias("trimmed"), tx.contains_text(F.upper("event_type"), "E").alias("has_e"),
        tx.prefixed_id("P", F.col("user_id")).alias("id"),
    )


@query("f19_epoch_ms", sql("SELECT event_id, CAST(timestamp AS BIGINT) AS back, hour(make_timestamp(CAST(timestamp AS BIGINT) * 1000))::INTEGER AS hour FROM sig", SIG))
def f19(spark, d):
    from ..functions import text as tx

    t = tx.from_epoch_ms(F.col("timestamp"))
    return sig(spark, d).select("event_id", tx.to_epoch_ms(t).alias("back"), F.hour(t).alias("hour"))


@query("t01_total_order", sql("SELECT participant, session, timestamp, event_id FROM sig ORDER BY ALL", SIG))
def t01(spark, d):
    return st.total_order(sig(spark, d).select(*KEYS, "timestamp", "event_id"), [*KEYS, "timestamp", "event_id"])


@query(
    "t05_duplicated_stamps",
    sql("SELECT timestamp, participant, session, event_id FROM dup WHERE timestamp IN (SELECT timestamp FROM dup GROUP BY timestamp HAVING count(*) > 1) ORDER BY event_id LIMIT 10", DUPES),
)
def t05(spark, d):
    return pf.duplicated_stamps(dupes(spark, d).select("timestamp", *KEYS, "event_id"), "timestamp", ["event_id"])


@query(
    "t06_best_per_criterion",
    """WITH m AS (SELECT p_brand AS model, avg(p_retailprice) AS score, CAST(max(p_size) AS DOUBLE) AS size FROM part GROUP BY p_brand)
SELECT 'score' AS criterion, (SELECT model FROM m ORDER BY score DESC, model LIMIT 1) AS model, round((SELECT max(score) FROM m), 6) AS value
UNION ALL SELECT 'size', (SELECT model FROM m ORDER BY size, model LIMIT 1), (SELECT min(size) FROM m)""",
)
def t06(spark, d):
    m = table(spark, d, "part").groupBy(F.col("p_brand").alias("model")).agg(F.avg("p_retailprice").alias("score"), F.max("p_size").alias("size"))
    return st.best_per(m, "model", {"score": "max", "size": "min"}).withColumn("value", r6("value"))


@query(
    "u01_union_sessions",
    sql("SELECT participant, session, timestamp, CASE WHEN event_type = 'click' THEN value END AS click_value, CASE WHEN event_type = 'view' THEN value END AS view_value FROM sig WHERE event_type IN ('click', 'view')", SIG),
)
def u01(spark, d):
    return st.union_sessions([sensor(spark, d, "click"), sensor(spark, d, "view")])


@query("u03_distinct_sessions", sql("SELECT DISTINCT participant, session FROM sig WHERE participant >= 1", SIG))
def u03(spark, d):
    return st.distinct_sessions(sig(spark, d), KEYS, 1)


@query("u04_labels_present", sql("SELECT y AS label FROM pred UNION SELECT p FROM pred", PRED))
def u04(spark, d):
    return st.labels_present(pred(spark, d), "y", "p")


@query(
    "u05_missing_keys",
    sql("SELECT DISTINCT participant, session FROM sig EXCEPT SELECT participant, session FROM sig WHERE event_type = 'error'", SIG),
)
def u05(spark, d):
    s = sig(spark, d)
    return st.missing_keys(s.select(*KEYS).distinct(), s.where("event_type = 'error'").select(*KEYS))
