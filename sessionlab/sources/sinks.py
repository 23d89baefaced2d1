"""Writers: datasets, metric documents and soft-label bundles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of a first key that one file takes before its rows are dealt to several.
ROWS_PER_FILE = 1_000_000


def write_dataset(df: DataFrame, path: str, keys: Sequence[str], features: Sequence[str], label: str, fmt: str = "parquet", files: int = 8) -> None:
    """Keys, features and label in fixed order, partitioned by the first key with at most ``files`` files each, however many tasks write.

    Only keys of more than ``ROWS_PER_FILE`` rows have several files, so their number follows keys and rows.
    """
    out = df.select(*keys, *features, label)
    if fmt == "csv":
        out.write.mode("overwrite").option("header", True).csv(path)
    else:
        first, share = f"_{keys[0]}_of", f"_{keys[0]}_share"
        sizes = out.groupBy(F.col(keys[0]).alias(first)).agg(F.count(F.lit(1)).alias(share)).where(F.col(share) > ROWS_PER_FILE)
        split = F.when(F.col(share).isNotNull(), F.pmod(F.xxhash64(*keys), F.least(F.lit(files), F.ceil(F.col(share) / ROWS_PER_FILE))))
        # one row for ROWS_PER_FILE rows at most
        dealt = out.join(F.broadcast(sizes), F.col(keys[0]).eqNullSafe(F.col(first)), "left").withColumn(share, F.coalesce(split, F.lit(0))).drop(first)
        tasks = 8 * df.sparkSession.sparkContext.defaultParallelism
        dealt = dealt.repartition(tasks, keys[0], share).drop(share)
        dealt.write.mode("overwrite").partitionBy(keys[0]).format(fmt).save(path)


METRICS_SCHEMA = (
    "mean_f1 double, std_f1 double, mean_bal_acc double, std_bal_acc double, params map<string,string>, "
    "folds array<struct<fold: int, participant: string, session: string, f1_macro: double, balanced_accuracy: double>>, model string"
)


def upsert_metrics(store: str, doc: DataFrame) -> None:
    """Replace the documents of the models in ``doc``; other models stay (dynamic partition overwrite)."""
    doc.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model").parquet(store)


def read_metrics(spark: SparkSession, store: str) -> DataFrame:
    """All metric documents; an absent or empty store reads as no rows."""
    try:
        return spark.read.schema(METRICS_SCHEMA).parquet(store)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], METRICS_SCHEMA)
        raise


def write_soft_labels(df: DataFrame, path: str, features: Sequence[str], window: str = "window") -> None:
    """Soft-label bundle; the feature list travels as metadata of the window column."""
    tagged = df.withColumn(window, F.col(window).alias(window, metadata={"features": list(features)}))
    tagged.write.mode("overwrite").parquet(path)


def read_soft_labels(spark: SparkSession, path: str, features: Sequence[str], window: str = "window") -> DataFrame:
    """Read a bundle, refusing one written for another feature list."""
    df = spark.read.parquet(path)
    written = df.schema[window].metadata.get("features")
    if written != list(features):
        raise ValueError(f"soft labels were written for {written}")
    return df
