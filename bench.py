"""Headline queries timed on ``local[$BENCH_CPUS]`` at ``$BENCH_SF_DIR``; prints one JSON line."""

from __future__ import annotations

import contextlib
import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from logwarden.plans.registry import queries  # noqa: E402

HEADLINE = (
    "detections", "incidents", "hostile_ips", "asset_inventory", "user_profiles", "activity_series", "report_summary",
    "parse_log_lines", "classify_documents", "numeric_profile", "dataset_audit", "targeted_features", "one_hot_and_scale",
    "threshold_sweep", "auc", "recall_by_label", "effect_sizes", "reason_codes", "isolation_forest_scores", "batch_scores",
    "stream_hostile",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    with contextlib.redirect_stdout(sys.stderr):
        spark = (
            SparkSession.builder.master(f"local[{cpus}]").appName("logwarden-bench")
            .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.driver.memory", "12g")
            .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate())
        spark.sparkContext.setLogLevel("ERROR")
        built = queries()
        spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").count().collect()  # warm the session, not the queries
        took = {}
        for name in HEADLINE:
            start = time.perf_counter()
            built[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took[name] = round(time.perf_counter() - start, 3)
        spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
                      "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
