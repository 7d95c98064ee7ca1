"""Time the headline queries; prints one JSON line.

Tables from $BENCH_SF_DIR, on local[$BENCH_CPUS].
"""

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from querybook import QUERIES  # noqa: E402

HEADLINES = [
    "p6_identity_text", "p8_customer_row", "e5_stats_report", "a7_identity_clusters",
    "j1_topk_exact", "j1_topk_exact_cells", "w1_topk_identities", "j3_duplicate_pairs",
    "j4_hard_negative", "j5_shared_keys", "j6_approximate_nearest", "x7_feature_row_batched",
    "e1_duplicate_check", "e1_check_by_keys", "e2_ingest", "e3_labelled_pairs",
    "m10_training_features", "e6_loan_check",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("likeness-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="likeness-bench-"))
        .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/customer.parquet").count()
    timings = {}
    for name in sys.argv[1:] or HEADLINES:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
