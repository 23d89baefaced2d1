"""Sketched quantiles stay within their rank error, also of every left-out fold."""

import numpy as np

from sessionlab.operators import sketches


def ranks(x, q):
    return np.searchsorted(x, q, "left") / len(x), np.searchsorted(x, q, "right") / len(x)


def test_left_out_folds_within_rank_error(spark):
    rng = np.random.default_rng(5)
    rows = [(p, s, float(v), None if i % 3 else float(i)) for p in range(5) for s in range(4) for i, v in enumerate(np.round(rng.lognormal(p, 2, 30 + 900 * (p == 1))))]
    df = spark.createDataFrame([*rows, (None, 0, 1.0, None), (9, 9, None, float("nan"))], "p int, s int, v double, w double")
    probs = [0.05, 0.25, 0.5, 0.75, 0.95]
    for k in (200, 8000):
        one = sketches.sketch(df, ["p", "s"], ["v", "w"], k)
        got = sketches.leave_one_out_quantiles(one, ["p", "s"], probs).collect()
        assert len(got) == 21 + 20
        for r in got:
            at = 2 if r["column"] == "v" else 3
            x = np.sort([t[at] for t in [*rows, (None, 0, 1.0, None)] if t[:2] != (r.p, r.s) and t[at] is not None])
            assert r.n == len(x)
            for i, p in enumerate(probs):
                lo, hi = ranks(x, r[f"q{i}"])
                slack = (sketches.rank_error(k) * 1.5 if k == 200 else 0) + 1 / len(x)
                assert lo - slack <= p <= hi + slack


def test_groups_single_folds_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (1, "b", 4.0), (2, "a", 9.0)], "p int, s string, v double")
    one = sketches.sketch(df, ["p", "s"], ["v"])
    assert [tuple(r) for r in sketches.quantiles(one, [0.0, 1.0], ["p"]).orderBy("p").collect()] == [(1, "v", 3, 1.0, 4.0), (2, "v", 1, 9.0, 9.0)]
    assert [tuple(r) for r in sketches.quantiles(one, [0.5]).collect()] == [("v", 4, 2.0)]
    single = sketches.sketch(df.where("p = 2"), ["p", "s"], ["v"])
    assert [tuple(r) for r in sketches.leave_one_out_quantiles(single, ["p", "s"], [0.5]).collect()] == [(2, "a", "v", 0, None)]
    assert sketches.robust_fit_folds(single, ["p", "s"]).count() == 0
    assert sketches.leave_one_out_quantiles(sketches.sketch(df.limit(0), ["p", "s"], ["v"]), ["p", "s"], [0.5]).count() == 0
