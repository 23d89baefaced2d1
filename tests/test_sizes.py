"""What must not grow with the input: broadcasts, counters, files."""

from pyspark.sql import functions as F

from sessionlab.session import broadcast_if_small, cut_lineage


def test_a_table_whose_files_are_small_but_whose_rows_are_many_is_not_broadcast(spark):
    keys = spark.range(900_000, numPartitions=4).select(F.xxhash64("id").alias("a"), F.xxhash64("id", F.lit(1)).alias("b"))
    hint = "ResolvedHint (strategy=broadcast)"
    assert hint not in broadcast_if_small(cut_lineage(keys))._jdf.queryExecution().analyzed().toString()
    assert hint in broadcast_if_small(cut_lineage(keys.limit(1000)))._jdf.queryExecution().analyzed().toString()

def test_tie_corrections_beyond_a_long(spark):
    from sessionlab.operators.evaluate import signed_ranks, wilcoxon

    pairs = spark.range(3_200_000).select(F.lit(2.0).alias("a"), F.when(F.col("id") % 8 == 0, 1.0).otherwise(3.0).alias("b"))
    assert int(signed_ranks(pairs, "a", "b").first()["ties"]) == 3_200_000**3 - 3_200_000
    row = wilcoxon(pairs, "a", "b").first()
    assert row["n"] == 3_200_000 and row["ties"] == float(3_200_000**3 - 3_200_000) and row["p"] == 0.0


def test_only_long_keys_have_several_files(spark, tmp_path, monkeypatch):
    from sessionlab.sources import sinks

    monkeypatch.setattr(sinks, "ROWS_PER_FILE", 50)
    rows = spark.range(300).selectExpr("if(id < 200, null, if(id < 220, 1, 2)) AS p", "id AS t", "double(id) AS v", "0 AS label")
    path = str(tmp_path / "set")
    sinks.write_dataset(rows, path, ["p", "t"], ["v"], "label")
    count = {d.name: len(list(d.glob("*.parquet"))) for d in (tmp_path / "set").iterdir() if d.is_dir()}
    assert count["p=1"] == 1 and 1 < count["p=2"] <= 2 and 1 < count["p=__HIVE_DEFAULT_PARTITION__"] <= 4
    assert sorted(r.t for r in spark.read.parquet(path).collect()) == list(range(300))
