"""Seconds of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS], as one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from basalt import suite

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "seq_scan", "project_columns", "filter_conjunction", "like_contains", "index_lookup", "index_range_ge", "sorted_scan_rank", "sort_external",
    "join_two_way", "join_three_way", "join_four_way", "join_nested_loop", "join_broadcast", "join_sort_merge", "join_hash", "join_pushdown_filters",
    "agg_global_sum_float", "group_all_aggs", "group_cluster", "join_group_agg", "histogram_float", "histogram_string", "hist_mask_ge", "table_stats", "join_estimate",
    "index_bulkload_layout", "insert_post", "update_where_post", "csv_ingest_string_rules",
]


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    suite.QUERIES["join_group_agg"](spark, SF_DIR).write.format("noop").mode("overwrite").save()  # starts the engine
    seconds = {}
    for name in HEADLINE:
        began = time.perf_counter()
        suite.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    sf = os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
