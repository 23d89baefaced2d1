"""Options of the fold run: scaling by training rows, and pseudo-labels without the left-out session."""

import numpy as np
import pytest

from sessionlab.operators import folds, scale
from sessionlab.operators.readout import random_forest
from sessionlab.operators.windows import window_stats

NAMES = [f"v_{s}" for s in ("mean", "std", "min", "max", "median")]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    out = []
    for p in range(3):
        for i in range(90):
            label = -1 if i >= 66 else (i // 33)
            out.append((p, 0, float(i), float(rng.normal() + 4 * max(label, i % 2) + 100 * p), label, p * 1000 + i))
    return spark.createDataFrame(out, "participant int, session int, t double, v double, label int, id long").cache()


def made(rows):
    balanced = folds.balanced_rows(rows, ["participant", "session"], "id", "t", ["v"], "label")
    windows = folds.evaluation_windows(rows, ["participant", "session"], "id", "t", ["v"], "label", 6, 3, balanced=balanced)
    return balanced, windows, scale.robust_fit_folds(balanced, ["participant"], ["v"])


def test_scaled_windows_are_windows_of_scaled_rows(rows):
    _, windows, scalers = made(rows)
    for r in scalers.collect():
        scaled = rows.where("label <> -1").withColumn("v", (rows["v"] - r["center"]) / r["scale"])
        want = window_stats(scaled, ["participant", "session"], ["t", "id"], ["v"], 6, 3, label="label").orderBy("participant", "window_id").toPandas()
        got = folds.scaled_windows(windows[1], {"v": (r["center"], r["scale"])}, NAMES).orderBy("participant", "window_id").toPandas()
        np.testing.assert_allclose(got[NAMES], want[NAMES], atol=1e-9)


def test_scalers_know_nothing_of_the_left_out_fold(rows):
    balanced, _, scalers = made(rows)
    seen = balanced.select("participant", "v").toPandas()
    for r in scalers.collect():
        low, mid, high = np.quantile(seen[seen["participant"] != r["participant"]]["v"], [0.25, 0.5, 0.75])
        np.testing.assert_allclose([r["center"], r["scale"]], [mid, high - low])


def test_left_out_session_gives_no_pseudo_labels(rows):
    _, windows, scalers = made(rows)
    pool = {r["participant"]: r["count"] for r in windows[2].groupBy("participant").count().collect()}
    run = lambda **k: {r["participant"]: r for r in folds.run_folds(windows, "participant", [0, 1, 2], NAMES, "label", random_forest(3, 3), threshold=0.0, **k).collect()}
    plain, kept_out = run(), run(scalers=scalers, exclude_test_session=True)
    for p in range(3):
        assert plain[p]["n_pseudo"] == sum(pool.values())
        assert kept_out[p]["n_pseudo"] == sum(pool.values()) - pool[p]
        assert plain[p]["n_train"] == kept_out[p]["n_train"] and plain[p]["n_test"] == kept_out[p]["n_test"]
