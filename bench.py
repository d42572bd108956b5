"""Times the headline queries and prints one JSON line."""

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

QUERIES = ("hybrid_search", "sparse_topk", "dense_topk_cosine", "chunk_parents", "tokens_tf", "eval_summary")


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from lexispark.plans.queries import queries

    known, times = queries(), {}
    for name in QUERIES:
        each = []
        for _ in range(runs + 1):  # the first one warms up
            began = time.time()
            known[name](spark, sf).write.format("noop").mode("overwrite").save()
            each.append(time.time() - began)
        times[name] = round(statistics.median(each[1:]), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf.rstrip("/").rpartition("/")[2]}))
    spark.stop()


if __name__ == "__main__":
    main()
