"""Benchmark: headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS].

Each query is fully executed through the no-op sink (no collect). Prints one
JSON line: {"metric", "value", "unit", "queries", "sf"}.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from passagekit.plans.registry import QUERIES  # noqa: E402
from passagekit.session import get_spark  # noqa: E402

HEADLINE = [
    "article_sections",   # F1-F10 article parsing
    "dedup_stats",        # ids + exact dedup counters
    "reindex_ids",        # full corpus build
    "encode_hash",        # encoder (sparse form)
    "knn_flat",           # exact top-k
    "knn_sharded",
    "context_dataset",    # flagship retrieval chain
    "mc_pairs_answers",
    "eval_map3",
]


def warm_up(spark, cpus: int) -> None:
    """Untimed: JVM JIT, Python worker start-up on every core, package shipping."""
    from pyspark.sql import functions as F

    from passagekit.operators import encode
    spark.range(1000).selectExpr("sum(id)").collect()
    df = spark.range(0, 64 * cpus, numPartitions=cpus).select(F.concat(F.lit("warm "), F.col("id").cast("string")).alias("text"))
    encode.encode(df, encode.HashingEncoder(8)).write.format("noop").mode("overwrite").save()


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = get_spark(f"local[{cpus}]", app="passagekit-bench", shuffle_partitions=int(cpus) * 2,
                      extra={"spark.driver.memory": "16g"})
    warm_up(spark, int(cpus))
    times = {}
    for n in names:
        t0 = time.time()
        QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.time() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else None}))


if __name__ == "__main__":
    main()
