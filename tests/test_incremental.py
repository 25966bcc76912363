"""A corpus built in batches against one build of everything."""

import pytest
from pyspark.sql import functions as F

from passagekit.plans import corpus_build, incremental
from passagekit.session import scratch_path
from passagekit.sources import fixtures as fx

SF = "/root/testdata/sf0.001"
COLS = incremental.SECTION_COLUMNS


@pytest.fixture(scope="module")
def articles(spark):
    return fx.articles(spark.read.parquet(f"{SF}/documents.parquet"))


@pytest.fixture(scope="module")
def one_build(articles):
    paths = corpus_build.build_corpus(articles, scratch_path(articles.sparkSession, "t-one"), rows_per_file=40)
    return sorted(map(tuple, articles.sparkSession.read.parquet(paths.sections).select(*COLS).collect()))


def rows(store):
    return sorted(map(tuple, store.sections().select(*COLS).collect()))


def test_two_batches_give_one_build_and_a_killed_run_is_repeated(spark, articles, one_build, monkeypatch):
    path = scratch_path(spark, "t-store")
    store = incremental.Store(spark, path, rows_per_file=40, buckets=4)
    assert rows(store) == []
    first, second = articles.where("doc_id < 90"), articles.where("doc_id >= 90")
    assert incremental.add_batch(store, first, 0)
    before = rows(store)
    assert 0 < len(before) < len(one_build)

    # killed before the log is written: the batch does not count, and leaves files behind
    with monkeypatch.context() as m:
        m.setattr(spark.catalog.__class__, "refreshTable", lambda *_: None)
        m.setattr(incremental, "_LOG", "broken")
        with pytest.raises(Exception):
            incremental.add_batch(store, second, 1)
    again = incremental.Store(spark, path)
    assert (again.rows_per_file, again.buckets) == (40, 4)
    assert rows(again) == before
    assert incremental.add_batch(again, second, 1)
    assert rows(again) == one_build
    # finished batches are skipped, later ones must follow
    monkeypatch.setattr(corpus_build, "stage_sections", None)
    assert not incremental.add_batch(again, second, 1)
    assert sorted(r.batch for r in again.log().collect()) == [0, 1]


def test_nothing_new_and_empty_batches(spark, articles, one_build):
    store = incremental.Store(spark, scratch_path(spark, "t-store"), rows_per_file=40, buckets=4)
    assert incremental.add_batch(store, articles, 3)
    assert rows(store) == one_build
    assert incremental.add_batch(store, articles.where("doc_id < 0"), 4)
    assert incremental.add_batch(store, articles.withColumn("doc_id", F.col("doc_id") + 1000), 5)
    assert rows(store) == one_build
    last = store.log().where("batch = 5").first()
    assert last.kept == 0 and last.next_id == len(one_build)
    with pytest.raises(ValueError):
        incremental.add_batch(store, articles, 2)


def test_the_store_is_not_shuffled_and_gets_a_bloom_filter(spark, articles):
    store = incremental.Store(spark, scratch_path(spark, "t-store"), rows_per_file=40, buckets=6)
    incremental.add_batch(store, articles, 0)
    keys = scratch_path(spark, "t-keys")
    spark.range(50).select(F.sha2(F.col("id").cast("string"), 256).alias("h"), F.col("id").alias("id1")).write.parquet(keys)
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false",
            "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        df = incremental.new_hashes(store, spark.read.parquet(keys))
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert df.count() == 50
    finally:
        for k in conf:
            spark.conf.unset(k)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "might_contain" in plan
    scan = [i for i, line in enumerate(plan.splitlines()) if store.table in line or "Bucketed: true" in line]
    assert scan, plan
    lines = plan.splitlines()
    depth = lambda s: len(s) - len(s.lstrip(" :+-*()0123456789"))
    # between the store's scan and the join above it there is no exchange
    i = scan[0]
    for line in reversed(lines[:i]):
        if "Join" in line:
            break
        assert not ("Exchange" in line and depth(line) < depth(lines[i])), plan
