"""Spark session defaults and the cluster checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


#: Whether a query's shuffle files are deleted when it ends.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(master: str | None = None, app: str = "sessionlab", **conf: str) -> SparkSession:
    """Session with the library defaults; every value can be overridden."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULT_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for reliable checkpoints: the cluster's if named, else one for this (local) run."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return current
    if named is None and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="sessionlab-ckpt-"))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame, **options: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back; ``options`` are those of the Parquet writer.

    Later stages then survive lost executors, the plan stays small, and the optimizer knows
    the table's true size when it decides on a broadcast. What was shuffled for the table goes as
    soon as it is written, not when the driver next collects garbage.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    conf = df.sparkSession.conf
    before = conf.get(SHUFFLES_GO, "false")
    conf.set(SHUFFLES_GO, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        conf.set(SHUFFLES_GO, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables that ``cut_lineage`` wrote, once nothing that is still to run reads them."""
    for df in tables:
        path = getattr(df, "_written_to", None)
        if path is not None:
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def broadcast_if_small(df: DataFrame, max_bytes: int = 8 << 20) -> DataFrame:
    """Hint a broadcast only when the optimizer's own size estimate proves it small.

    For tables the estimate is the size of compressed files; as a hash table on the driver and on every executor, the rows take several times
    that, often of two tables at a time. So the limit is far below the memory of a small driver, and does not depend on the input.
    """
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return F.broadcast(df) if int(str(size)) <= max_bytes else df
