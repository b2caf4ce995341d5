"""Time the headline queries and print one JSON line.

Every result is written out in full to Spark's no-op sink, so nothing is pruned
away. Each query runs twice; the second time counts (the first compiles code).
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fleetair.checks import QUERIES  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "flagship_labelled_pairs j1_pair_latest j2_label_asof j3_ambient_asof j4_with_calibration "
    "w1_order_by_sequence w3_cadence_sample w4_cadence_violations w5_trailing_means "
    "w6_log_resistance_stats w7_boot_segments w8_aqi_band w9_hold_last w10_label_intervals "
    "f7_decode_codes f12_timestamp_check f12_timestamp_check_drop d1_decode_frame "
    "d4_comp_pressure d5_comp_humidity d7_rmox_array d9_ambient_hs4 r1_to_long r2_to_wide "
    "a4_fit_scaler a5_confusion_matrix a6_classification_report a8_self_test k2_argmax_class "
    "m1_stratified_split m2_standardise m5_dense_score m6_score_readings "
    "s2_parse_output_lines t1_stream_pair"
).split()


def run(spark: SparkSession, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in names:
        run(spark, name)
        times[name] = round(run(spark, name), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
