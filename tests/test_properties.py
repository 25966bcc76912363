"""Results must not depend on the number of shuffle partitions; top-k plans
limit before their exchange."""

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["reindex_ids", "dedup_stats", "knn_sharded", "rerank_lines"])
def test_shuffle_partitions_invariance(spark, name):
    results = []
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "16"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            df = E.queries()[name](spark, SF)
            results.append(sorted((tuple(r) for r in df.collect()), key=repr))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert results[0] == results[1] and results[0]


def test_rerank_plan_limits_before_exchange(spark):
    df = E.queries()["rerank_lines"](spark, SF)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2      # partial and final
