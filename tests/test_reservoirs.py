"""Reservoirs of several sensors in padded batches against one sensor and one window at a time."""

import numpy as np
import pytest

from sessionlab.operators import readout


@pytest.mark.parametrize("cells,summary", [(1 << 21, "last_mean_std"), (40, "last_mean"), (1, "last")])
def test_sensors_together_equal_sensors_alone(spark, cells, summary):
    rng = np.random.default_rng(3)
    made = lambda n_in, t: None if t is None else [[float(v) for v in rng.normal(size=n_in)] for _ in range(t)]
    lengths = [(5, 12), (None, 3), (7, None), (0, 4), (1, 1), (5, 2), (None, None), (30, 12)]
    rows = [(k, made(2, a), made(1, b)) for k, (a, b) in enumerate(lengths)]
    df = spark.createDataFrame(rows, "id int, acc array<array<double>>, eda array<array<double>>").repartition(2)
    options = {"units": 6, "washout": 2, "summary": summary}
    got = {r.id: (r.features, r.missing) for r in readout.sensor_reservoirs(df, {"acc": 2, "eda": 1}, cells=cells, **options).collect()}
    width = 6 * {"last": 1, "last_mean": 2, "last_mean_std": 3}[summary]
    for k, (name, n_in) in enumerate((("acc", 2), ("eda", 1))):
        there = df.where(f"size({name}) > 0").select("id", name)
        alone = {r.id: r.features for r in readout.reservoir_features(there, name, n_in, seed=42 + k, **options).collect()}
        for i in range(len(rows)):
            part = got[i][0][k * width : (k + 1) * width]
            np.testing.assert_allclose(part, alone.get(i, [0.0] * width), atol=1e-12)
            assert got[i][1][k] == (i not in alone)
    assert readout.sensor_reservoirs(df.limit(0), {"acc": 2, "eda": 1}, **options).count() == 0
