"""Tables laid out by id, and the search over one-byte vectors."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagekit.operators import knn, quantized
from passagekit.session import scratch_path
from passagekit.sources import lookup


def frame(spark, v, ids, name):
    return spark.createDataFrame([(int(i), [float(x) for x in r]) for i, r in zip(ids, v)], f"{name} long, embedding array<float>")


def rows(df):
    return sorted((r.prompt_id, r.rank, r.id, None if np.isnan(r.dist) else r.dist) for r in df.collect())


def test_lookup_does_not_shuffle_the_tables(spark):
    path, other = scratch_path(spark, "t-look"), scratch_path(spark, "t-look2")
    df = spark.range(500).select("id", F.concat(F.lit("t"), F.col("id")).alias("text"))
    lookup.write_lookup(df, path, buckets=6)
    lookup.write_lookup(df.select("id", (F.col("id") % 7).alias("file")), other, buckets=6)
    spark.sql(f"DROP TABLE {lookup.table_name(path)}")          # as in another session: opened by its path
    a, b = lookup.open_lookup(spark, path, buckets=6), spark.table(lookup.table_name(other))
    keys = spark.createDataFrame([(3,), (3,), (499,), (1000,)], "id long")
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        got = lookup.look_up(a.join(b, "id"), keys)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, got.collect())) == [(3, "t3", 3), (499, "t499", 2)]
    finally:
        for k in conf:
            spark.conf.unset(k)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    # only the keys are exchanged: once to be distinct, once into the tables' buckets
    exchanges = re.findall(r"Exchange hashpartitioning\((id#\d+L), (\d+)\)", plan)
    assert plan.count("Exchange ") == len(exchanges) == 2 and len({x[0] for x in exchanges}) == 1
    assert exchanges[0][1] == "6" and plan.count("Bucketed: true") == 2


@pytest.mark.parametrize("k", [1, 15, 500])
def test_bytes_equal_flat(spark, k):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(400, 12)).astype(np.float32)
    v[100:230] = v[5]                                           # a third of all vectors are one
    v[230:260] = v[6] + rng.normal(size=(30, 12)) * 1e-4        # nearer to each other than the rounding
    v[300] = 0
    v[310:316, 2] = np.nan
    v[317, 1] = np.inf
    q = np.vstack([v[:10], v[230:232], v[300:301], v[310:311], rng.normal(size=(6, 12)) * 50]).astype(np.float32)
    finite = frame(spark, v, np.arange(400) * 2, "id")
    qs = frame(spark, q, range(len(q)), "prompt_id")
    index = quantized.build_byte_index(finite, scratch_path(spark, "t-bytes"), buckets=4)
    got = quantized.search_bytes(qs, index, k, vectors_per_block=150, queries_per_block=8)
    want = knn.knn(qs, finite.where("id <> 634"), k)            # the flat search has no rule for infinite components
    have = [r for r in rows(got.hits) if r[2] != 634]
    if k < 100:
        assert have == rows(want)
        report = quantized.bytes_report(got).first()
        assert report.vectors == 393 and report.first_bytes == 393 * (12 + 12) and report.flat_bytes == 393 * 12 * 4
        assert report.second_bytes == report.fetched * 12 * 4
        assert k > 1 or report.first_bytes + report.second_bytes < report.flat_bytes
    else:
        assert [r for r in have if r[3] is not None] == [r for r in rows(want) if r[3] is not None]
    assert rows(quantized.search_bytes(qs.limit(0), index, 3).hits) == []


def test_ranges_hold_a_few_small_matrices():
    import tracemalloc

    import pyarrow as pa
    rng = np.random.default_rng(4)
    q, v = rng.normal(size=(1024, 16)).astype(np.float32), rng.integers(-127, 128, (20_000, 16)).astype(np.int8)
    left = pa.table({"prompt_id": np.arange(1024), "embedding": pa.array(list(q), pa.list_(pa.float32()))})
    right = pa.table({"id": np.arange(20_000), "code": pa.array([x.tobytes() for x in v], pa.binary()),
                      "scale": pa.array(np.full(20_000, 0.02), pa.float32()), "lost": np.full(20_000, 0.01)})
    tracemalloc.start()
    out = quantized._ranges(5)(left, right)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 128 << 20              # a matrix of 1024 x 8192 numbers has 64 MB, and several were held
    d = np.sqrt(((q[:8, None].astype(float) - v[None] * np.float64(np.float32(0.02))) ** 2).sum(axis=2))
    found = out.to_pandas()
    for i in range(8):
        need = np.flatnonzero(d[i] - 0.01 <= np.sort(d[i] + 0.01)[4])
        assert set(need) <= set(found[found.prompt_id == i].id)
