"""Ordered queries with tiny chunks, so that state really crosses chunk borders, against the stated SQL."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from sessionlab.operators import neighbours, ordered

DATA = "/root/testdata/sf0.001"
NAMES = [
    "w01_marker_intervals", "w04_resample_mean", "w05_resample_ffill", "w06_resample_linear_time", "w08_ffill_bfill", "w09_interpolate_limited",
    "w14_window_stats", "w20_label_runs", "j01_asof_nearest", "j02_fuse_sensors_asof", "j05_label_rows", "j11_knn_within", "a08_continuity",
    "x01_majority_smoothing_batch", "m27_signed_ranks", "session_windows",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables absent")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql_with_tiny_chunks(spark, con, monkeypatch, name):
    monkeypatch.setattr(ordered, "ROWS_PER_CHUNK", 5)
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 3)
    df = entry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    rel = con.execute(entry.oracle_sql()[name])
    at = [[d[0] for d in rel.description].index(c) for c in cols]
    assert got == sorted(repr(tuple(r[i] for i in at)) for r in rel.fetchall())


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
