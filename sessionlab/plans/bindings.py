"""Driver tables seen as session data: signals, sensors, markers, vectors, predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR = 3_600_000.0
ORIGIN = 1_704_067_200_000  # 2024-01-01T00:00:00Z in epoch ms
KEYS = ["participant", "session"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(col) -> Column:
    """Six decimals on both sides of a comparison, with a single zero."""
    return F.round(F.col(col) if isinstance(col, str) else col, 6) + F.lit(0.0)


def epoch_ms(col: str) -> Column:
    return F.unix_millis(F.col(col).cast("timestamp"))


def label_code() -> Column:
    t = F.col("event_type")
    return (
        F.when(t == "view", 0).when(t == "click", 1).when(t == "signup", 2).when(t == "purchase", 3).otherwise(-1)
    ).cast("int")


def sig(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as labelled signal rows: one session per user and 11-day block."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("participant"),
        F.floor((F.dayofmonth("ts") - 1) / 11).cast("int").alias("session"),
        (epoch_ms("ts") - ORIGIN).cast("double").alias("timestamp"),
        "value",
        label_code().alias("label"),
        "event_id",
        "event_type",
    )


def nullable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signal rows whose value is missing on every seventh event."""
    return sig(spark, sf_dir).withColumn("value", F.when(F.col("event_id") % 7 != 0, F.col("value")))


def dupes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signal rows with every tenth row repeated."""
    s = sig(spark, sf_dir)
    return s.unionByName(s.where("event_id % 10 = 0"))


def sensor(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """One event type as a sensor stream."""
    return sig(spark, sf_dir).where(F.col("event_type") == kind).select(*KEYS, "timestamp", F.col("value").alias(f"{kind}_value"))


def markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as start/end markers in file order (event_id)."""
    t = F.col("event_type")
    name = (
        F.when(t == "signup", "start_activity")
        .when(t == "purchase", "end_activity")
        .when(t == "view", "start_fatigue")
        .when(t == "error", "end_fatigue")
        .otherwise("tick")
    )
    return sig(spark, sf_dir).select(*KEYS, "timestamp", name.alias("marker"), F.col("event_id").alias("pos"))


def vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        "vec_id", (F.col("vec_id") % 5).cast("int").alias("session"), "label", F.col("embedding").cast("array<double>").alias("vec")
    )


def pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "labels")
    return p.select("doc_id", F.col("quality").alias("y"), F.col("toxic").alias("p"), (F.col("doc_id") % 6).cast("int").alias("fold"))


SIG = """sig AS (SELECT user_id AS participant, CAST((day(ts) - 1) // 11 AS INTEGER) AS session,
 CAST(epoch_us(ts) // 1000 - 1704067200000 AS DOUBLE) AS timestamp, value,
 CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 ELSE -1 END AS label,
 event_id, event_type FROM events)"""
NULLABLE = SIG + """, nul AS (SELECT participant, session, timestamp,
 CASE WHEN event_id % 7 <> 0 THEN value END AS value, label, event_id, event_type FROM sig)"""
DUPES = SIG + """, dup AS (SELECT * FROM sig UNION ALL SELECT * FROM sig WHERE event_id % 10 = 0)"""
MARKERS = SIG + """, markers AS (SELECT participant, session, timestamp, event_id AS pos,
 CASE event_type WHEN 'signup' THEN 'start_activity' WHEN 'purchase' THEN 'end_activity'
 WHEN 'view' THEN 'start_fatigue' WHEN 'error' THEN 'end_fatigue' ELSE 'tick' END AS marker FROM sig)"""
VEC = """vec AS (SELECT vec_id, CAST(vec_id % 5 AS INTEGER) AS session, label, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings)"""
PRED = """pred AS (SELECT doc_id, quality AS y, toxic AS p, CAST(doc_id % 6 AS INTEGER) AS fold FROM labels)"""


def sql(template: str, *preludes: str) -> str:
    """Prefix a statement with the common table expressions it uses."""
    body = template.strip()
    ctes = ", ".join(preludes)
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes} {body}"
