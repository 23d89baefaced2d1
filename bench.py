"""Headline queries, median of three runs: one JSON line with seconds per query."""

from __future__ import annotations

import json
import os
import statistics
import time

from sessionlab.plans import all_queries
from sessionlab.session import build_session

HEADLINE = [
    "session_windows", "s02_normalize_sensor", "w01_marker_intervals", "w04_resample_mean", "w05_resample_ffill", "w06_resample_linear_time",
    "w08_ffill_bfill", "w14_window_stats", "w20_label_runs", "w25_overlapping_window_stats", "j01_asof_nearest", "j02_fuse_sensors_asof",
    "j03_fuse_sensors_outer", "j05_label_rows", "j07_window_rows", "j11_knn_within", "a02_missing", "a03_duplicates", "a04_describe", "a09_outliers",
    "a10_correlation", "a18_box_stats", "m01_robust_scale", "m04_zscore", "m13_loso_readout", "m20_metrics", "f10_pulse_features",
    "x02_resample_mean_stream", "m06_smote_windows", "w30_breathing_rate",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    spark = build_session(
        f"local[{cpus}]", "bench", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    all_queries.QUERIES["a05_labels"](spark, sf_dir).collect()  # JVM warm-up
    seconds = {}
    for name in HEADLINE:
        runs = []
        for _ in range(repeats):
            start = time.perf_counter()
            all_queries.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(runs), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir)}))
    spark.stop()


if __name__ == "__main__":
    main()
