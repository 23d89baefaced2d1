"""Correlations of wide tables with gaps, and medians of sliding windows, against plain versions."""

import numpy as np
import pandas as pd

from sessionlab.operators import comoments, sliding


def test_correlations_of_200_columns_equal_pairwise_complete(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 12))
    x = base @ rng.normal(size=(12, 200)) + rng.normal(size=(300, 200)) + 1e6
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 7], x[:, 8] = 5.0, np.nan
    x[2:, 9] = np.nan
    cols = [f"v{k}" for k in range(200)]
    frame = pd.DataFrame(x, columns=cols)
    df = spark.createDataFrame(frame).repartition(5)
    got = {(r.a, r.b): r.r for r in comoments.corr_matrix_wide(df, cols, None).collect()}
    want = frame.corr()
    assert len(got) == 200 * 199 // 2
    for (a, b), r in got.items():
        both = frame[[a, b]].dropna()
        if len(both) < 2 or "v7" in (a, b):
            assert r is None
        elif len(both) > 2:
            assert abs(r - want.loc[a, b]) < 1e-6


def test_sums_of_two_tables_add_up(spark):
    df = spark.createDataFrame([(float(i % 7), float(i * i % 11), None if i % 3 else float("nan") if i % 2 else float(i)) for i in range(60)], "a double, b double, c double")
    cols, shift = ["a", "b", "c"], [1.0, 2.0, 3.0]
    whole = {r.i: np.array([r.n, r.s, r.q, r.p]) for r in comoments.masked_sums(df, cols, shift).collect()}
    parts = [comoments.masked_sums(df.where(f"a {op} 3"), cols, shift).collect() for op in ("<", ">=")]
    for i, want in whole.items():
        np.testing.assert_allclose(sum(np.array([r.n, r.s, r.q, r.p]) for rows in parts for r in rows if r.i == i), want)
    assert comoments.corr_matrix_wide(df.limit(0), cols).count() == 0


def test_medians_for_any_chunk(spark):
    rng = np.random.default_rng(8)
    rows = [(k, f"s{k % 3}" if k % 5 else None, float(t), None if rng.random() < 0.2 or t < 20 and k == 1 else float(rng.integers(0, 9)) if t % 13 else float("nan")) for k in range(8) for t in range(int(rng.integers(1, 260)))]
    df = spark.createDataFrame(rows, "p int, s string, t double, v double").repartition(4)
    for size, step in ((16, 2), (5, 9), (20, 3)):
        want = []
        for p in range(8):
            mine = [(t, v) for q, name, t, v in rows if q == p and name]
            for w, a in enumerate(range(0, len(mine) - size + 1, step)):
                held = np.sort([v for _, v in mine[a : a + size] if v is not None])
                m = None if not len(held) else held[len(held) // 2] if len(held) % 2 else (held[len(held) // 2 - 1] + held[len(held) // 2]) / 2
                want.append((p, w, mine[a][0], repr(None if m is None else float(m))))
        for chunk in (1, 100_000):
            got = sliding.sliding_medians(df, ["p", "s"], ["t"], ["v"], size, step, chunk).collect()
            assert sorted((r.p, r.window_id, r.start, repr(r.v_median)) for r in got) == sorted(want)


def test_medians_of_long_windows_equal_sorting():
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=9000), 2)
    held = rng.random(9000) > 0.1
    got = sliding.run_medians(x, held, 2000, 25)
    np.testing.assert_allclose(got, [np.median(x[a : a + 2000][held[a : a + 2000]]) for a in range(0, 7001, 25)])
