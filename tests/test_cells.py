"""Pruned exact search and bucket search against the flat search."""

import numpy as np
import pytest

from passagekit.operators import cells, knn
from passagekit.session import scratch_path


def frame(spark, v, ids, name):
    return spark.createDataFrame([(int(i), [float(x) for x in r]) for i, r in zip(ids, v)], f"{name} long, embedding array<float>")


def rows(df):
    return sorted((r.prompt_id, r.rank, r.id, None if np.isnan(r.dist) else r.dist) for r in df.collect())


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(5)
    means = rng.normal(size=(12, 8)) * 6
    v = (means[rng.integers(0, 12, 900)] + rng.normal(size=(900, 8)) * 0.3).astype(np.float32)
    v[100:400] = v[7]                            # a third of all vectors are one
    q = np.vstack([v[:20], v[7:8] + 1e-3, rng.normal(size=(4, 8)) * 6]).astype(np.float32)
    return v, q


@pytest.mark.parametrize("k", [3, 25])
def test_pruned_equals_flat_and_reads_a_part(spark, clustered, k):
    v, q = clustered
    vs, qs = frame(spark, v, range(900), "id"), frame(spark, q, range(len(q)), "prompt_id")
    index = cells.build_cell_index(vs, scratch_path(spark, "t-cells"), cells=20)
    got = cells.search_cells(qs, index, k, vectors_per_block=100, queries_per_block=10)
    assert rows(got.hits) == rows(knn.knn(qs, vs, k))
    report = cells.pruned_report(got).collect()
    assert len(report) == len(q) and all(r.vectors == 900 and r.cells_read <= r.cells for r in report)
    assert sum(r.cells_read for r in report) < 0.5 * sum(r.cells for r in report)
    # opened again from its files
    again = cells.search_cells(qs, cells.open_cell_index(spark, index.path), k)
    assert rows(again.hits) == rows(got.hits)


def test_pruned_with_nan_few_rows_and_ties(spark):
    rng = np.random.default_rng(6)
    v = rng.integers(-2, 3, size=(40, 3)).astype(np.float32)        # many equal distances
    v[5:15, 1] = np.nan
    q = np.vstack([v[:8], rng.integers(-2, 3, size=(6, 3))]).astype(np.float32)
    vs, qs = frame(spark, v, np.arange(40) * 3, "id"), frame(spark, q, range(len(q)), "prompt_id")
    index = cells.build_cell_index(vs, scratch_path(spark, "t-cells"), cells=7, pivots=2)
    for k in (4, 35):                                               # 35: more than there are finite vectors
        assert rows(cells.search_cells(qs, index, k).hits) == rows(knn.knn(qs, vs, k))


def test_nothing_to_search(spark, clustered):
    v, q = clustered
    vs, qs = frame(spark, v, range(900), "id"), frame(spark, q, range(len(q)), "prompt_id")
    none = cells.build_cell_index(vs.limit(0), scratch_path(spark, "t-cells"))
    assert cells.search_cells(qs, none, 5).hits.count() == 0
    index = cells.build_cell_index(vs, scratch_path(spark, "t-cells"), cells=3)
    assert cells.search_cells(qs.limit(0), index, 5).hits.count() == 0


def test_bounds_never_exceed_the_distance():
    rng = np.random.default_rng(7)
    v, q = rng.normal(size=(200, 5)), rng.normal(size=(30, 5))
    c = cells.fit_centroids(v, 9)
    near = cells._distances(v, c).argmin(axis=1)
    d = np.c_[np.linalg.norm(v - c[near], axis=1), cells._distances(v, c[:4])]
    low = np.stack([d[near == i].min(axis=0) for i in range(9)])
    high = np.stack([d[near == i].max(axis=0) for i in range(9)])
    b = cells.Bounds(c, c[:4], low, high, np.bincount(near), np.arange(9))
    below, _ = b.below(q)
    true = cells._distances(q, v)
    assert all((below[:, i] <= true[:, near == i].min(axis=1)).all() for i in range(9))


def test_bucket_search_meets_its_recall(spark, clustered):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(1500, 16)).astype(np.float32)              # no structure: the hard case
    q = rng.normal(size=(80, 16)).astype(np.float32)
    vs, qs = frame(spark, v, range(1500), "id"), frame(spark, q, range(80), "prompt_id")
    index = cells.build_bucket_index(vs, scratch_path(spark, "t-buckets"), bits=5)
    exact = knn.knn(qs, vs, 10).persist()
    found = cells.search_buckets(qs, index, 10, vectors_per_block=40, queries_per_block=30).persist()
    r = cells.recall_of(found, exact).first()
    assert r.queries == 80 and r.wanted == 800 and 0.9 <= r.recall < 1
    want = {(x.prompt_id, x.id): x.dist for x in exact.collect()}
    assert all(want.get((x.prompt_id, x.id), x.dist) == x.dist for x in found.collect())
    everything = cells.search_buckets(qs, index, 10, probes=1 << 5)
    assert rows(everything) == rows(exact)


def test_probes_are_fitted_whatever_the_session_does_with_pandas(spark):
    rng = np.random.default_rng(9)
    v = rng.normal(size=(300, 6)).astype(np.float32)
    vs, qs = frame(spark, v, range(300), "id"), frame(spark, v[:12], range(12), "prompt_id")
    index = cells.build_bucket_index(vs, scratch_path(spark, "t-buckets"), bits=3)
    want = cells.probes_for(qs, index, 5, 0.95)
    key = "spark.sql.execution.arrow.pyspark.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")                                    # Spark's default
    try:
        assert cells.probes_for(qs, index, 5, 0.95) == want
    finally:
        spark.conf.set(key, before)


def test_probing_order_is_by_distance_to_the_bucket():
    sides = np.array([[0.5, -0.1, 2.0]])
    miss = cells._misses(sides)[0]
    assert cells._codes(sides[:, None])[0, 0] == 0b101 == miss.argmin()
    assert np.isclose(miss[0b111], 0.01) and np.isclose(miss[0b100], 0.25) and np.isclose(miss[0b110], 0.26)
