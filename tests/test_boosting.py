"""Boosted trees on distributed histograms against plain NumPy."""

import numpy as np
import pytest

from sessionlab.operators import boosting as bo
from sessionlab.operators import search as se


def data(n=900, seed=3):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 4)), 2)
    y = (x[:, 0] > 0.3).astype(int) + (x[:, 1] + 0.3 * rng.normal(size=n) > 0) * (x[:, 0] > -0.5)
    return x, y, rng.integers(1, 4, n).astype(float), rng.integers(0, 4, n)


def frame(spark, x, y, w, f, parts=5):
    rows = [([None if v != v else float(v) for v in r], int(c), float(q), int(k)) for r, c, q, k in zip(x, y, w, f, strict=True)]
    return spark.createDataFrame(rows, "vec array<double>, y int, w double, fold int").repartition(parts)


def plain_tree(bins, g, h, params, depth):
    """One regression tree by exhaustive search, as {node: (feature, cut)} and leaf values."""
    splits, values = {}, {}

    def grow(node, rows, level):
        G, H = g[rows].sum(), h[rows].sum()
        values[node] = -params.learning_rate * G / (H + params.l2)
        if level == depth:
            return
        best = None
        for f in range(bins.shape[1]):
            for c in range(params.bins - 1):
                left = rows[bins[rows, f] <= c]
                right = rows[bins[rows, f] > c]
                if min(len(left), len(right)) < params.min_rows:
                    continue
                gain = sum(g[s].sum() ** 2 / (h[s].sum() + params.l2) for s in (left, right)) - G**2 / (H + params.l2)
                if best is None or gain > best[0] + 1e-9:
                    best = (gain, f, c, left, right)
        if best and best[0] > 1e-9:
            splits[node] = best[1:3]
            grow(2 * node + 1, best[3], level + 1)
            grow(2 * node + 2, best[4], level + 1)

    grow(0, np.arange(len(bins)), 0)
    return splits, values


def test_one_round_equals_plain_trees(spark):
    x, y, w, f = data(300)
    x[::17, 2] = np.nan
    params = bo.Params(rounds=1, depth=2, bins=8)
    model = bo.fit(frame(spark, x, y, w, f), "vec", 4, "y", [0, 1, 2], params, weight="w")[0]
    bins = np.stack([np.searchsorted(model.edges[k], x[:, k], side="left") for k in range(4)], axis=1)
    share = np.array([w[y == c].sum() for c in range(3)])
    np.testing.assert_allclose(model.prior, np.log(share / share.sum()))
    g, h, _ = bo.gradients(np.tile(model.prior, (300, 1)), y, w)
    for k, tree in enumerate(model.trees[0]):
        splits, values = plain_tree(bins, g[:, k], h[:, k], params, 2)
        assert {n: (int(tree.feature[n]), int(tree.cut[n])) for n in range(7) if tree.feature[n] >= 0} == splits
        for n, v in values.items():
            assert abs(tree.value[n] - v) < 1e-9


def test_columns_score_like_the_node_arrays(spark):
    x, y, w, f = data(400)
    x[::13, 0] = np.nan
    df = frame(spark, x, y, w, f)
    model = bo.fit(df, "vec", 4, "y", [0, 1, 2], bo.Params(rounds=12, depth=3, bins=16, rows=0.8, features=0.75))[0]
    rows = model.predict(df, "vec", [0, 1, 2]).collect()
    seen = np.array([[np.nan if v is None else v for v in r.vec] for r in rows])
    margin = model.margins(np.stack([np.searchsorted(model.edges[k], seen[:, k], side="left") for k in range(4)], axis=1))
    want = np.exp(margin) / np.exp(margin).sum(axis=1, keepdims=True)
    np.testing.assert_allclose([r.probability for r in rows], want, atol=1e-9)
    assert [r.prediction for r in rows] == want.argmax(axis=1).tolist()
    assert np.mean([r.prediction == r.y for r in rows]) > 0.85


def test_scores_carried_by_blocks_change_nothing(spark, monkeypatch):
    df = frame(spark, *data(300)).cache()
    grown = []
    for refresh in (2, 100):
        monkeypatch.setattr(bo, "REFRESH", refresh)
        grown.append(bo.fit(df, "vec", 4, "y", [0, 1, 2], bo.Params(rounds=5, depth=2, bins=8))[0])
    for a, b in zip(*[m.trees for m in grown], strict=True):
        for s, t in zip(a, b, strict=True):
            assert s.feature.tolist() == t.feature.tolist() and s.cut.tolist() == t.cut.tolist()
            np.testing.assert_allclose(s.value, t.value)


def test_left_out_folds_grow_alone_and_stop_early(spark):
    x, y, w, f = data(600)
    df = frame(spark, x, y, w, f).cache()
    params = bo.Params(rounds=4, depth=2, bins=8)
    together = bo.fit(df, "vec", 4, "y", [0, 1, 2], params, fold="fold", left_out=[0, 3])
    assert [m.left_out for m in together] == [0, 3]
    # a model without fold 3 equals one fitted on a table without it, on the same bins
    edges = together[1].edges
    alone = bo.Model(together[1].prior, edges)
    blocks = bo.binned_blocks(df.where("fold <> 3"), "vec", "y", [0, 1, 2], edges)
    for _ in range(4):
        bo._round(blocks, [alone], [0], params, 0)
    for a, b in zip(alone.trees, together[1].trees, strict=True):
        for s, t in zip(a, b, strict=True):
            assert s.feature.tolist() == t.feature.tolist() and s.cut.tolist() == t.cut.tolist()
    rng = np.random.default_rng(0)
    noise = frame(spark, x, rng.permutation(y), w, f)
    m = bo.fit(noise, "vec", 4, "y", [0, 1, 2], bo.Params(rounds=40, depth=3, bins=16, learning_rate=0.5, patience=2), fold="fold", left_out=[1])[0]
    assert m.stopped and len(m.trees) < 10 and m.best_rounds() < len(m.trees)


def test_odd_rows(spark):
    df = spark.createDataFrame([([1.0, None], 0), ([None, None], 1), ([2.0, 3.0], None), ([5.0, float("nan")], 1)], "vec array<double>, y int")
    model = bo.fit(df, "vec", 2, "y", [0, 1], bo.Params(rounds=2, depth=1, bins=4, min_rows=1))[0]
    assert model.predict(df, "vec", [0, 1]).where("prediction is null").count() == 0
    none = bo.fit(df.limit(0), "vec", 2, "y", [0, 1], bo.Params(rounds=1, depth=1))[0]
    assert none.predict(df, "vec", [0, 1]).count() == 4
    with pytest.raises(ValueError):
        bo.fit(df, "vec", 2, "y", [0, 1], bo.Params(bins=300))


SPACE = {"a": se.Whole(1, 9), "b": se.Real(1e-4, 1.0, log=True), "c": se.Real(0, 1), "d": se.Choice(("x", "y"))}


def test_draws_are_seeded_and_stay_in_range():
    some = se.draw(SPACE, 50, 7)
    assert some == se.draw(SPACE, 60, 7)[:50] != se.draw(SPACE, 50, 8)
    assert all(1 <= s["a"] <= 9 and 1e-4 <= s["b"] <= 1 and 0 <= s["c"] <= 1 and s["d"] in "xy" for s in some)
    assert np.median([s["b"] for s in some]) < 0.1 and {s["d"] for s in some} == {"x", "y"}


def test_halving_finds_the_best_with_fewer_fits():
    some, folds, fits = se.draw(SPACE, 16, 1), list(range(8)), []

    def evaluate(params, asked):
        fits.extend(asked)
        return {f: params["c"] + 0.001 * f for f in asked}

    trials = se.halving(some, folds, evaluate)
    assert trials[0].params == max(some, key=lambda s: s["c"]) and len(trials[0].scores) == 8
    assert len(fits) == 16 + 8 + 4 * 2 + 2 * 4 < 16 * 8
    assert len(trials) == 16 and [len(t.scores) for t in trials] == sorted((len(t.scores) for t in trials), reverse=True)
    assert se.halving(some, folds, evaluate) == trials and se.halving([], folds, evaluate) == []
