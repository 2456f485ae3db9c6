"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the folder of tables (default /root/testdata/sf0.1), BENCH_CPUS the local cores (default 8). Every query
runs to the last row into a sink that drops the rows. The prediction runs and the label file, inputs of most queries, are
derived and written first; their time is reported as derive_inputs and counted.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "overlap_guard", "soft_targets", "slice_metrics", "leaderboard",
    "auroc_and_threshold", "runtime_percentiles", "bootstrap_interval", "option_order_bias", "candidate_report",
    "default_calibration", "cross_fitted_calibration", "calibration_from_dev", "ensemble_of_runs", "averaged_orders",
    "capped_mix", "downsample_to_rarest", "global_shuffle", "family_sample", "first_pool_wins", "decontaminated_documents", "exact_copies_dropped",
    "prompt_table", "long_context", "windowed_batches", "token_batches", "release_statistics", "model_provenance_gate",
    "sla_breach", "agent_loop", "alert_same_incident",
]


def main() -> int:
    from pyspark.sql import SparkSession

    from plumbline import plans

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-")).getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    queries = plans.all_queries()
    names = sys.argv[1:] or HEADLINE
    from plumbline.sources import derived
    spark.range(1000).selectExpr("sum(id)").collect()
    start = time.perf_counter()
    derived.predictions(spark, folder)
    derived.labels(spark, folder)
    took = {"derive_inputs": round(time.perf_counter() - start, 3)}  # cases, runs and label file, written once; counted in the total
    for name in names:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {took[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
                      "sf": folder.rsplit("sf", 1)[-1]}))
    spark.stop()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
