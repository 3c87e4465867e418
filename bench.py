"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

from claimloom.catalog import QUERIES

HEADLINE = [
    "J1_enrich_claims", "J2_enrich_unprocessed", "J3_training_set", "J4_transactions", "R6_claim_summary",
    "P8_P9_P10_claim_measures", "A1_status_summary", "A2_processing_statistics", "A3_daily_processing",
    "A4_status_distribution", "A5_chunk_status", "A6_validation_statistics", "A7_validation_trends",
    "M2_frequent_itemsets", "M5_rule_definitions", "M8_evaluate_rules", "M9_evaluate_all_active", "M9_rule_coverage",
    "V5_validate_claims", "W1_top_filters", "W3_interval_rate", "W4_assign_chunks", "K1_advance_status", "K3_upsert_retry",
    "X4_windowed_rate", "X5_alerts", "T5_classification_report", "T6_roc_auc",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("claimloom-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="claimloom-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    run("A1_status_summary")  # start the executors and load classes
    seconds = {name: run(name) for name in names}
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
