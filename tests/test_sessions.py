"""Hand-made sessions with known answers for the edge cases of alignment and labelling."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sessionlab.operators import balance, breathing, evaluate, joins, profile, timeseries, windows
from sessionlab.operators import ordered
from sessionlab.sources import sessions, sinks


def frame(spark, rows, schema):
    return spark.createDataFrame([("p", "s", *r) for r in rows], "participant string, session string, " + schema)


KEYS = ["participant", "session"]


def values(df, *cols):
    return [tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.orderBy("timestamp").collect()]


def test_resample_mean_negative_time_and_gap(spark):
    df = frame(spark, [(-300.0, 1.0), (-100.0, 2.0), (100.0, 3.0), (800.0, 5.0)], "timestamp double, v double")
    got = values(timeseries.resample_mean(df, KEYS, "timestamp", ["v"], 250), "timestamp", "v")
    assert got == [(-500.0, 1.0), (-250.0, 2.0), (0.0, 3.0), (250.0, None), (500.0, None), (750.0, 5.0)]


def test_resample_ffill_off_grid(spark):
    df = frame(spark, [(130.0, 1.0), (1130.0, 2.0), (2130.0, 3.0), (3130.0, 4.0)], "timestamp double, v double")
    got = values(timeseries.resample_ffill(df, KEYS, "timestamp", ["v"], 250), "v")
    assert got == [None, 1, 1, 1, 1, 2, 2, 2, 2, 3, 3, 3, 3]


def test_resample_linear_modes(spark):
    on = frame(spark, [(0.0, 1.0), (1000.0, 2.0), (2000.0, 3.0), (3000.0, 4.0)], "timestamp double, v double")
    off = on.withColumn("timestamp", F.col("timestamp") + 130)
    want = [1 + i / 4 for i in range(13)]
    assert values(timeseries.resample_linear(on, KEYS, "timestamp", ["v"], 250, "exact"), "v") == want
    assert values(timeseries.resample_linear(on, KEYS, "timestamp", ["v"], 250, "time"), "v") == want
    assert values(timeseries.resample_linear(off, KEYS, "timestamp", ["v"], 250, "exact"), "v") == [None] * 13


def test_asof_ties_and_tolerance(spark):
    left = frame(spark, [(250.0,), (1000.0,), (1250.0,), (3000.0,)], "timestamp double")
    right = frame(spark, [(0.0, 1), (500.0, 2), (1250.0, 3), (1500.0, 4)], "timestamp double, v int")
    assert values(joins.asof_nearest(left, right, "timestamp", KEYS, 250, ["v"]), "v") == [1, 3, 3, None]


def test_markers_reopen_and_unclosed(spark):
    m = frame(
        spark, [(10.0, "start_baseline", 0), (12.0, "START_baseline", 1), (20.0, "end_baseline", 2), (25.0, "end_activity", 3), (30.0, "start_fatigue", 4)],
        "timestamp double, marker string, pos long",
    )
    got = timeseries.marker_intervals(m, ["baseline", "activity", "fatigue"], KEYS, "timestamp", "marker", "pos").collect()
    assert [(r["start"], r["end"], r["label"], r["t0"]) for r in got] == [(0.0, 8.0, "baseline", 12.0)]


def test_label_gap_and_bounds(spark):
    iv = frame(spark, [(0.0, 8.0, "baseline", 1), (10.0, 20.0, "activity", 2), (30.0, 40.0, "fatigue", 3)], "start double, `end` double, label string, ord long")
    rows = frame(spark, [(9.0,), (20.0,), (25.0,), (30.0,), (41.0,)], "timestamp double")
    got = values(joins.label_rows(rows, iv, ["baseline", "activity", "fatigue"], KEYS, "timestamp"), "label")
    assert got == ["unlabeled", "activity", "pre_fatigue", "fatigue"]
    extra = timeseries.augment_intervals(iv, KEYS).where("ord > 3").orderBy("ord").collect()
    assert [(r["start"], r["end"], r["label"]) for r in extra] == [(20.0, 30.0, "pre_fatigue"), (8.0, 10.0, "unlabeled")]


def test_window_count_and_majority_tie(spark):
    df = frame(spark, [(float(i), i % 2) for i in range(1003)], "timestamp double, label int")
    assert windows.window_stats(df, KEYS, ["timestamp"], ["timestamp"], 240, 120, ["mean"]).count() == 7
    n = spark.range(1).select(windows.count_windows(F.lit(1003), 240, 120).alias("n")).first()["n"]
    assert n == 7
    tie = frame(spark, [(3,), (1,), (3,), (1,), (2,)], "label int")
    assert tie.agg(windows.majority("label").alias("m")).first()["m"] == 1


def test_moments_and_weights(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4, 10)], "x double")
    r = profile.profile_stats(df, ["x"], decimals=6).first()
    assert (r["skewness"], r["kurtosis"], r["q25"], r["q75"]) == (1.697056, 3.152, 2.0, 4.0)
    w = {r["y"]: r["weight"] for r in profile.class_weights(spark.createDataFrame([(0,)] * 2 + [(1,)] * 6, "y int"), "y").collect()}
    assert w[0] == 2.0 and math.isclose(w[1], 2 / 3)


def test_smote_plan_counts(spark):
    counts = {3: 1949, 2: 1251, 1: 737, 0: 721}
    df = spark.createDataFrame([(k,) for k, n in counts.items() for _ in range(n)], "label int").withColumn("s", F.lit(1))
    plan = {r["label"]: r for r in balance.smote_plan(df, ["s"], "label").collect()}
    assert sum(r["need"] for r in plan.values()) == 3138 and all(r["n"] + r["need"] == 1949 for r in plan.values())


def test_smote_values_lie_between_neighbours(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 2))
    rows = [(1, i, float(i), float(a), float(b), 0 if i < 30 else 1) for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "s int, id long, t double, a double, b double, y int")
    out = balance.smote(df, ["s"], ["a", "b"], "y", "id", "t").toPandas()
    assert out.groupby("y").size().tolist() == [30, 30]
    new = out[out["synthetic"]]
    real = x[30:]
    assert (new["a"].between(real[:, 0].min(), real[:, 0].max())).all()
    assert set(new["t"]) <= {float(i) + 1.0 for i in range(40)}  # nearest stamp + median step of 1


@pytest.mark.parametrize("per_chunk", [3, 1_000_000])
def test_thin_min_gap_equals_loop(spark, monkeypatch, per_chunk):
    monkeypatch.setattr(ordered, "ROWS_PER_CHUNK", per_chunk)
    ts = np.sort(np.random.default_rng(9).uniform(0, 100, 80))
    want, last = [], -1e18
    for t in ts:
        if t - last >= 2.5:
            want.append(t)
            last = t
    df = frame(spark, [(float(t),) for t in ts], "timestamp double")
    assert values(timeseries.thin_min_gap(df, KEYS, "timestamp", 2.5), "timestamp") == want


def test_interpolate_limited(spark):
    v = [None, None, None, 1.0, None, None, None, None, None, None, 8.0, None]
    df = frame(spark, [(float(i), x) for i, x in enumerate(v)], "timestamp double, v double")
    got = values(timeseries.interpolate_limited(df, KEYS, "timestamp", "v", 2), "v")
    assert got == [1, 1, 1, 1, 2, 3, 3, 3, 6, 7, 8, 8]


def test_bandpass_chunks_match_whole(spark):
    b, a = breathing.butter2_bandpass(0.05, 0.8, 25.0)
    gain = abs(np.polyval(b, np.exp(2j * np.pi * 0.2 / 25)) / np.polyval(a, np.exp(2j * np.pi * 0.2 / 25)))
    assert abs(gain - 1) < 1e-6 and abs(np.polyval(b, 1.0)) < 1e-12
    t = np.arange(9000)
    wave = 1000 * np.sin(2 * np.pi * 0.25 * t / 25) + 300 * np.sin(2 * np.pi * 3 * t / 25) + 50
    df = frame(spark, [(float(i), float(x)) for i, x in zip(t, wave)], "timestamp double, v double")
    whole = values(breathing.bandpass(df, KEYS, "timestamp", "v", 0.05, 0.8, 25.0), "v")
    parts = values(breathing.bandpass(df, KEYS, "timestamp", "v", 0.05, 0.8, 25.0, chunk_rows=2000), "v")
    np.testing.assert_allclose(parts, whole, atol=1e-8)
    rate = breathing.breathing_rate(df, KEYS, "timestamp", "v", 25.0, (0.05, 0.8), 1.5, 100, 500).toPandas()
    assert np.median(rate["breathing_rpm"]) == 15.0 and rate["breathing_q"].median() == 1


def test_peaks_distance_and_prominence():
    x = np.array([0, 2, 0, 3, 0, 1, 0, 5, 5, 0.0])
    p = breathing.local_peaks(x)
    assert p.tolist() == [1, 3, 5, 7]
    assert p[breathing.by_distance(p, x[p], 3)].tolist() == [3, 7]
    assert breathing.prominence(x, np.array([3, 7])).tolist() == [3.0, 5.0]


def test_signed_rank_p():
    # exact distribution for n = 5: P(W <= 0) two-sided = 2 / 32
    assert evaluate.signed_rank_p(0, 5, 0) == 0.0625
    assert 0.9 < evaluate.signed_rank_p(1275, 71, 10) < 1.0


def test_composite_score(spark):
    r = spark.range(1).select(
        evaluate.composite_score(F.lit(0.827), F.lit(0.168), F.lit(0.14)).alias("a"), evaluate.composite_score(F.lit(0.836), F.lit(0.171), F.lit(None).cast("double")).alias("b")
    ).first()
    assert (r["a"], r["b"]) == (0.880, 0.824)


def test_min_samples_rounds_half_even():
    assert windows.min_samples(4, 60, 0.35) == 84
    assert windows.min_samples(0.65, 60, 0.35) == 8
    assert windows.min_samples(1, 5, 0.5) == 2


def test_session_tree(spark, tmp_path):
    d = tmp_path / "1" / "2"
    d.mkdir(parents=True)
    (d / "wrist_hr.csv").write_text(" Timestamp ,HR\n3,70\n1,60\nbad,1\n")
    (d / "wrist_hr_2.csv").write_text(" Timestamp ,HR\n1,99\n5,\n7,80\n")
    (d / "exp_markers.csv").write_text("utcTime , eventMarker\n1,start_baseline\n4,end_baseline\n")
    got = sessions.read_sensor(spark, str(tmp_path), "hr")
    assert [tuple(r) for r in got.orderBy("timestamp").collect()] == [("1", "2", 1.0, 60.0), ("1", "2", 3.0, 70.0), ("1", "2", 7.0, 80.0)]
    iv = timeseries.marker_intervals(sessions.read_markers(spark, str(tmp_path)), ["baseline"], KEYS, "timestamp", "marker", "pos")
    assert sessions.read_sessions(spark, str(tmp_path), iv)["hr"].count() == 3
    assert sessions.read_sensor(spark, str(tmp_path), "temp") is None


def test_soft_label_guard_and_empty_store(spark, tmp_path):
    df = spark.createDataFrame([(1, [[1.0]])], "id int, window array<array<double>>")
    sinks.write_soft_labels(df, str(tmp_path / "w"), ["a"])
    assert sinks.read_soft_labels(spark, str(tmp_path / "w"), ["a"]).count() == 1
    with pytest.raises(ValueError):
        sinks.read_soft_labels(spark, str(tmp_path / "w"), ["b"])
    assert sinks.read_metrics(spark, str(tmp_path / "none")).count() == 0


def test_metrics_class_sets(spark):
    df = spark.createDataFrame([(0, 0), (0, 2), (1, 1)], "y int, p int")
    r = evaluate.metrics(df, "y", "p").first()
    f1 = [2 / 3, 1.0, 0.0]
    assert math.isclose(r["f1_macro"], sum(f1) / 3) and math.isclose(r["balanced_accuracy"], 0.75)
    assert pd.notna(r["recall_focus"]) and r["recall_focus"] == 0.0


def test_next_higher_chunk_equals_a_plain_search(spark):
    rng = np.random.default_rng(2)
    chunks = [(k, i, float(rng.integers(0, 40) + 40 * (rng.random() < 0.01)), float(-rng.integers(0, 40))) for k in (1, 2) for i in range(700 if k == 1 else 9)]
    asked = [(k, int(i), p, float(rng.integers(0, 80)), int(w), 5.0) for p, (k, i, w) in enumerate((k, i, w) for k in (1, 2) for i in rng.integers(0, 700 if k == 1 else 9, 60) for w in (-1, 1))]
    got = breathing.next_higher(
        spark.createDataFrame(asked, "k int, _k long, pos long, height double, way int, low double"), spark.createDataFrame(chunks, "k int, id long, hi double, lo double"), ["k"]
    ).collect()
    by = {(k, i): (hi, lo) for k, i, hi, lo in chunks}
    want = []
    for k, i, p, height, way, low in asked:
        at = i + way
        while (k, at) in by and by[k, at][0] <= height:
            low = min(low, by[k, at][1])
            at += way
        want.append((p, low, at if (k, at) in by else None))
    assert sorted((r.pos, r.low, r["at"]) for r in got) == sorted(want)


def test_sessions_stream_through_tasks_whole(spark):
    rng = np.random.default_rng(6)
    rows = [(None if k == 3 else k, "é" * (k % 2), float(t), float(v)) for k in range(40) for t, v in enumerate(rng.normal(size=int(rng.integers(1, 60))))]
    df = spark.createDataFrame(rows, "participant int, session string, timestamp double, v double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sorted((r.participant or -1, r.timestamp, r.pos, r.height, r.prominence) for r in breathing.find_peaks(df, KEYS, "timestamp", "v", 3).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for k in range(40):
        x = np.array([v for p, _, _, v in rows if p == (None if k == 3 else k)])
        p = breathing.local_peaks(x)
        p = p[breathing.by_distance(p, x[p], 3)]
        want += [(-1 if k == 3 else k or -1, float(i), int(i), float(x[i]), float(q)) for i, q in zip(p, breathing.prominence(x, p), strict=True)]
    assert got == sorted(want)


def test_peaks_do_not_depend_on_chunks(spark):
    rng = np.random.default_rng(12)
    n = 4000
    x = np.round(np.cumsum(rng.normal(size=n)) * 0.2 + 3 * np.sin(np.arange(n) / 640) + np.where(np.arange(n) == 1418, 9, 0), 1)
    df = frame(spark, [(float(i), float(v)) for i, v in enumerate(x)], "timestamp double, v double")
    p = breathing.local_peaks(x)
    p = p[breathing.by_distance(p, x[p], 25)]
    want = [(int(i), float(x[i]), round(float(q), 9)) for i, q in zip(p, breathing.prominence(x, p))]
    for i, _, q in want[::7]:  # the plain definition
        left = next((k for k in range(i, -1, -1) if x[k] > x[i]), -1)
        right = next((k for k in range(i, n) if x[k] > x[i]), n)
        assert math.isclose(q, x[i] - max(x[left + 1 : i + 1].min(), x[i:right].min()), abs_tol=1e-9)
    for rows in (5, 50, 500, 500_000):
        got = breathing.find_peaks(df, KEYS, "timestamp", "v", 25, chunk_rows=rows).orderBy("pos").collect()
        assert [(r["pos"], r["height"], round(r["prominence"], 9)) for r in got] == want


def test_labels_whose_own_intervals_overlap(spark):
    iv = frame(spark, [(0.0, 100.0, "activity", 1), (10.0, 20.0, "activity", 2), (15.0, 60.0, "baseline", 3), (70.0, 80.0, "activity", 4)], "start double, `end` double, label string, ord long")
    rows = frame(spark, [(5.0,), (12.0,), (15.0,), (20.0,), (50.0,), (61.0,), (75.0,), (90.0,), (100.0,)], "timestamp double")
    got = values(joins.label_rows(rows, iv, ["baseline", "activity", "fatigue"], KEYS, "timestamp"), "label")
    assert got == ["activity", "activity", "baseline", "baseline", "baseline", "activity", "activity", "activity", "activity"]


def test_unlabelled_rows_do_not_train(spark):
    from sessionlab.operators import readout

    rows = [([1.0], 0), ([2.0], 0), ([3.0], 1), ([4.0], 1)]
    clean = spark.createDataFrame(rows, "v array<double>, y int")
    mixed = spark.createDataFrame(rows + [([9.0], -1), ([-5.0], None)], "v array<double>, y int")
    np.testing.assert_allclose(readout.ridge_readout(mixed, "v", 1, "y", 2, 1.0), readout.ridge_readout(clean, "v", 1, "y", 2, 1.0))


def test_forest_draws_at_any_size():
    from sessionlab.operators.decompose import draw_limit

    for n in (1, 500, 10**6, 10**10, 10**13):
        share = (draw_limit(n, 256) + 2**63) / 2**64
        assert 256 <= share * n <= 400 or share > 0.99 and n <= 384


def test_every_file_brings_its_own_header(spark, tmp_path):
    def put(session, name, text):
        path = tmp_path / "tree" / "p1" / session
        path.mkdir(parents=True, exist_ok=True)
        (path / name).write_text(text)

    put("s1", "wrist_hr_0.csv", "timestamp,HR \n1,60\n2,61\n2,99\n")
    put("s2", "wrist_hr_0.csv", "Quality, hr, Utc Time\n5,70,10\n5,,11\n\n7,72,12\n")
    put("s3", "wrist_hr_0.csv", "hr,quality\n80,1\n")
    put("s4", "wrist_hr_0.csv", "time,other\n1,1\n")
    for session in ("s1", "s2", "s3", "s4", "s5"):
        put(session, "exp_markers.csv", "utcTime, eventMarker\n1,\"start_activity, again\"\n")
    put("s1", "exp_markers_old.csv", "utcTime,eventMarker\n1,start_activity\n")
    root = str(tmp_path / "tree")
    marks = sessions.read_markers(spark, root)
    assert marks.count() == 5 and {r["marker"] for r in marks.collect()} == {"start_activity, again"}
    good, warned = sessions.read_sensor_checked(spark, root, {"hr": ("wrist_hr", {"hr": "wrist_hr"})}, marks.select(*KEYS).distinct())
    assert {(r["session"], r["warning"]) for r in warned.collect()} == {("s3", "missing clock"), ("s4", "no useful column"), ("s5", "missing file")}
    got = sorted(tuple(r) for r in sessions.normalize_files(*sessions.read_tree_csv(spark, root, "wrist_hr"), {"hr": "wrist_hr"}).where("session <> 's4'").collect())
    assert got == [("p1", "s1", 1.0, 60.0), ("p1", "s1", 2.0, 61.0), ("p1", "s2", 10.0, 70.0), ("p1", "s2", 12.0, 72.0)]
    assert good["hr"].where("session = 's2'").count() == 3
    assert sessions.read_breathing(spark, root) is None
