"""Chunked scans, quantiles and neighbours against plain windows, NumPy and brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sessionlab.operators.neighbours import nearest
from sessionlab.operators.ordered import with_chunk, explode_range, scan
from sessionlab.operators.quantile import leave_one_out_quantiles, quantiles


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"k": [0] * 200 + list(rng.integers(1, 6, 100)), "t": rng.permutation(300) * 1.5, "v": rng.normal(size=300)})
    pdf["v"] = pdf["v"].where(rng.random(300) > 0.4)
    return spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v")))


@pytest.mark.parametrize("per_chunk", [1, 7, 1_000_000])
def test_scan_equals_plain_window(rows, per_chunk):
    exprs = {
        "r": ("rank",), "c": ("cumsum", "v"), "l": ("last", "v"), "b": ("before", "v"), "n": ("next", "v"), "a": ("after", "v"),
        "p": ("before", F.struct("v")),
    }
    got = scan(rows, ["k"], ["t"], exprs, rows_per_chunk=per_chunk)
    w = Window.partitionBy("k").orderBy("t")
    up, un = Window.unboundedPreceding, Window.unboundedFollowing
    want = rows.select(
        "k", "t", "v", F.row_number().over(w).alias("r"), F.sum("v").over(w.rowsBetween(up, 0)).alias("c"),
        F.last("v", True).over(w.rowsBetween(up, 0)).alias("l"), F.last("v", True).over(w.rowsBetween(up, -1)).alias("b"),
        F.first("v", True).over(w.rowsBetween(0, un)).alias("n"), F.first("v", True).over(w.rowsBetween(1, un)).alias("a"),
        F.lag(F.struct("v")).over(w).alias("p"),
    )
    g = got.orderBy("k", "t").toPandas()
    x = want.orderBy("k", "t").toPandas()
    for c in ("r", "l", "b", "n", "a"):
        pd.testing.assert_series_equal(g[c], x[c], check_dtype=False)
    np.testing.assert_allclose(g["c"].astype(float), x["c"].astype(float))
    assert g["p"].tolist() == x["p"].tolist()


def test_scan_is_partition_invariant(rows):
    a = scan(rows.repartition(1), ["k"], ["t"], {"l": ("last", "v")}, rows_per_chunk=10).orderBy("k", "t").collect()
    b = scan(rows.repartition(37), ["k"], ["t"], {"l": ("last", "v")}, rows_per_chunk=10).orderBy("k", "t").collect()
    assert a == b


def test_explode_range_crosses_blocks(spark):
    df = spark.createDataFrame([(1, -5000, 9000), (2, 3, 3), (3, 4, 2)], "k int, lo long, hi long")
    got = explode_range(df, F.col("lo"), F.col("hi"), "i").groupBy("k").agg(F.count("i").alias("n"), F.min("i").alias("a"), F.max("i").alias("b")).orderBy("k").collect()
    assert [tuple(r) for r in got] == [(1, 14001, -5000, 9000), (2, 1, 3, 3)]


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(0, 1e-3, 400), rng.lognormal(3, 3, 300), -rng.lognormal(1, 2, 200), np.zeros(150), np.full(500, 7.25)])
    pdf = pd.DataFrame({"g": rng.integers(0, 3, len(values)), "x": values, "y": np.round(values, 1)})
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    out = {(r["g"], r["column"]): r for r in quantiles(spark.createDataFrame(pdf), ["x", "y"], probs, by=["g"]).collect()}
    for g, part in pdf.groupby("g"):
        for c in ("x", "y"):
            np.testing.assert_allclose([out[(g, c)][f"q{i}"] for i in range(len(probs))], np.quantile(part[c], probs), rtol=1e-12, atol=1e-15)


def test_leave_one_out_quantiles(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"f": rng.integers(0, 5, 400), "x": np.round(rng.normal(size=400), 2)})
    out = leave_one_out_quantiles(spark.createDataFrame(pdf), ["f"], ["x"], [0.25, 0.5]).collect()
    assert len(out) == 5
    for r in out:
        np.testing.assert_allclose([r["q0"], r["q1"]], np.quantile(pdf[pdf["f"] != r["f"]]["x"], [0.25, 0.5]))


@pytest.mark.parametrize("block_rows", [4, 4096])
def test_nearest_is_exact_with_copies(spark, block_rows):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(size=(40, 3)), np.tile(rng.normal(size=(1, 3)), (20, 1)), 50 + rng.normal(size=(10, 3))])
    data = pd.DataFrame({"g": 1, "nid": np.arange(len(x)), "vec": x.tolist()})
    sdf = spark.createDataFrame(data)
    got = nearest(sdf, sdf.withColumnRenamed("nid", "qid"), ["g"], 3, skip_self=True, block_rows=block_rows).toPandas()
    d2 = ((x[:, None] - x[None]) ** 2).sum(-1)
    np.fill_diagonal(d2, np.inf)
    assert len(got) == 3 * len(x)
    for q, part in got.groupby("qid"):
        np.testing.assert_allclose(np.sort(part["d2"]), np.sort(d2[q])[:3], atol=1e-12)


@pytest.mark.parametrize("stamps", ["even", "stray", "equal", "burst"])
def test_chunks_follow_rows_not_the_clock(spark, stamps):
    rng = np.random.default_rng(4)
    t = {"even": np.arange(20_000.0), "stray": np.append(0.0, 1.7e12 + np.arange(19_999.0)), "equal": np.zeros(20_000), "burst": np.exp(rng.normal(0, 6, 20_000))}[stamps]
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "t": t, "i": np.arange(20_000)}))
    out = with_chunk(df, ["k"], ["t", "i"], rows_per_chunk=1000).toPandas()
    assert out["_chunk"].value_counts().max() <= 2000
    assert out.sort_values(["t", "i"])["_chunk"].is_monotonic_increasing


def test_only_long_sessions_are_thinned_chunk_by_chunk(spark, monkeypatch):
    from sessionlab.operators import ordered, timeseries

    rows = spark.range(4000).selectExpr("if(id < 3900, id % 300, if(id < 3990, 300, null)) AS p", "double(id * 7919 % 1009) AS t")

    def thinned():
        return sorted((r.p, r.t) for r in timeseries.thin_min_gap(rows, ["p"], "t", 50.0).collect())

    want = []
    for p in range(301):
        last = None
        for t in sorted({k * 7919 % 1009 for k in range(3990) if (k % 300 if k < 3900 else 300) == p}):
            if last is None or t >= last + 50:
                last = t
                want.append((p, float(t)))
    assert thinned() == want
    monkeypatch.setattr(ordered, "ROWS_PER_CHUNK", 20)
    assert thinned() == want
    # with sessions of one chunk, rows of all sessions go through one Python pass
    monkeypatch.setattr(ordered, "ROWS_PER_CHUNK", 2_000_000)
    plan = timeseries.thin_min_gap(rows, ["p"], "t", 50.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan


def test_small_groups_share_calls_and_wide_vectors_are_exact(spark):
    """Many tiny groups go through a task in few batches; ties, copies and rounding of wide vectors rank as brute force does."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 6)) * 1e3
    rows = [(g, "a" if g % 2 else "b", int(i), [float(v) for v in base[(g + i) % 12] + (1e-9 * i if g % 3 else 0)]) for g in range(40) for i in range(7)]
    df = spark.createDataFrame(rows, "g int, s string, id bigint, vec array<double>").repartition(1)
    got = nearest(df.withColumnRenamed("id", "nid"), df.withColumnRenamed("id", "qid"), ["g", "s"], 3, skip_self=True)
    assert "FlatMapCoGroups" not in got._jdf.queryExecution().toString()
    found = sorted((r["g"], r["qid"], r["rank"], r["nid"], r["d2"]) for r in got.collect())
    want = []
    for g in range(40):
        mine = [(i, np.array(v)) for h, _, i, v in rows if h == g]
        for q, x in mine:
            d2 = {n: sum(((x[j] - y[j]) ** 2 for j in range(6)), 0.0) for n, y in mine if n != q}
            want += [(g, q, r + 1, n, d2[n]) for r, n in enumerate(sorted(d2, key=lambda n: (d2[n], n))[:3])]
    assert [f[:4] for f in found] == [w[:4] for w in sorted(want)]
    assert np.allclose([f[4] for f in found], [w[4] for w in sorted(want)], rtol=1e-12, atol=0)


def test_left_out_quantiles_do_not_grow_with_folds_times_buckets(spark):
    """No table of all folds by all buckets; copies, empty folds and folds without a key count as before."""
    rng = np.random.default_rng(5)
    rows = [(int(f) if f else None, float(v) if v else None) for f, v in zip(rng.integers(0, 9, 300), rng.integers(-6, 7, 300))]
    df = spark.createDataFrame(rows, "f int, x double")
    got = {r["f"]: (r["n"], r["q0"], r["q1"], r["q2"]) for r in leave_one_out_quantiles(df, ["f"], ["x"], [0.25, 0.5, 0.9]).collect()}
    for f in range(1, 9):
        rest = [v for g, v in rows if g != f and v is not None]
        assert got[f][0] == len(rest)
        assert np.allclose(got[f][1:], np.quantile(rest, [0.25, 0.5, 0.9]))
    assert set(got) == set(range(1, 9))
    many = spark.range(4000).selectExpr("id % 2000 AS f", "exp(pmod(hash(id), 2000) / 100.0) AS x")
    plan = leave_one_out_quantiles(many, ["f"], ["x"], [0.5])._jdf.queryExecution().toString()
    assert "LOG2" not in plan.upper()  # no buckets, so none for every fold
    assert leave_one_out_quantiles(df.where("f = 1"), ["f"], ["x"], [0.5]).count() == 0


def test_small_groups_are_compared_whole_and_side_by_side(spark, monkeypatch):
    """Groups of one block need no order and no rounds; ids that stand twice share one ranking; large groups among them still go by blocks."""
    from sessionlab.operators import neighbours

    rng = np.random.default_rng(11)
    rows = [(g, i, [float(x) for x in rng.integers(0, 4, 2)]) for g in range(40) for i in range(int(rng.integers(1, 9)))]
    rows += [(99, i, [float(x) for x in rng.integers(0, 9, 2)]) for i in range(60)]
    rows += [(3, 0, [2.0, 2.0]), (5, 1, [float("nan"), 1.0])]
    df = spark.createDataFrame(rows, "g long, nid long, vec array<double>")
    want = {}
    for g, q, v in rows:
        near = [(float(sum((x - y) ** 2 for x, y in zip(v, w))), n) for h, n, w in rows if h == g and n != q]
        want.setdefault((g, q), []).extend(x for x in near if x[0] == x[0])
    want = sorted((g, q, rank, d2) for (g, q), near in want.items() for rank, (d2, _) in enumerate(sorted(near)[:3], 1))
    calls = []
    monkeypatch.setattr(neighbours, "_nearest_of_blocks", lambda both, *a, _f=neighbours._nearest_of_blocks: calls.append(both.select("g").distinct().collect()) or _f(both, *a))
    got = nearest(df, df.withColumnRenamed("nid", "qid"), ["g"], 3, skip_self=True, block_rows=20)
    assert sorted((r.g, r.qid, r["rank"], r.d2) for r in got.collect()) == want
    assert [[r.g for r in c] for c in calls] == [[99]]
    nearest(df, df.withColumnRenamed("nid", "qid"), ["g"], 3, skip_self=True).count()
    assert len(calls) == 1
