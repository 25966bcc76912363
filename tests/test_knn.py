"""Exact top-k: every path against a brute-force NumPy answer."""

import numpy as np
import pytest

from passagekit.operators import knn


def brute(Q, qids, V, vids, k):
    out = []
    for qi, q in zip(qids, Q):
        d = np.round(((V.astype(np.float64) - q.astype(np.float64)) ** 2).sum(1), 6)
        order = sorted(range(len(vids)), key=lambda j: (d[j], vids[j]))[:k]
        out += [(int(qi), r + 1, int(vids[j]), float(d[j])) for r, j in enumerate(order)]
    return sorted(out)


def frames(spark, Q, qids, V, vids):
    q = spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(qids, Q)],
                              "prompt_id long, embedding array<float>")
    v = spark.createDataFrame([(int(i), [float(x) for x in r]) for i, r in zip(vids, V)],
                              "id long, embedding array<float>")
    return q, v


def rows(df):
    return sorted((r.prompt_id, r.rank, r.id, r.dist) for r in df.collect())


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(7)
    V = rng.normal(size=(300, 16)).astype(np.float32)
    V[50:150] = V[10]                 # a third of all rows are one vector
    V[200] = 0.0                      # zero vector
    Q = np.vstack([V[:5], rng.normal(size=(4, 16)).astype(np.float32)])
    return Q, np.arange(100, 109), V, np.arange(300) * 3 + 1


@pytest.mark.parametrize("k", [1, 20, 400])
def test_paths_equal_brute_force(spark, data, k):
    Q, qids, V, vids = data
    q, v = frames(spark, Q, qids, V, vids)
    exp = brute(Q, qids, V.astype(np.float32), vids, k)
    assert rows(knn.knn(q, v, k)) == exp
    assert rows(knn.knn(q, v, k, force_tiled=True, max_broadcast_bytes=256, vectors_per_tile=37)) == exp
    assert rows(knn.knn(q, v, k, strategy="blocked", max_broadcast_bytes=256)) == exp
    assert rows(knn.knn(q, v, k, strategy="vectors")) == exp


def test_auto_strategy_choices(spark, data):
    Q, qids, V, vids = data
    q, v = frames(spark, Q, qids, V, vids)
    exp = rows(knn.knn(q, v, 7))
    # queries over the bound, vectors under it -> vector broadcast
    assert rows(knn.knn(q, v.limit(300), 7, max_broadcast_bytes=300 * 16 * 8)) == exp
    # both over the bound -> blocked
    assert rows(knn.knn(q, v, 7, max_broadcast_bytes=512)) == exp


@pytest.mark.parametrize("shards", [1, 3, 16])
def test_sharded_equals_flat(spark, data, shards):
    Q, qids, V, vids = data
    q, v = frames(spark, Q, qids, V, np.arange(len(V)))
    flat = rows(knn.knn(q, v, 20))
    sv = knn.shard_vectors(v, shards)
    assert rows(knn.knn_sharded(q, sv, 20)) == flat
    assert rows(knn.knn_sharded(q, sv, 20, strategy="vectors")) == flat
    assert rows(knn.knn_sharded(q, sv, 20, strategy="blocked", max_broadcast_bytes=512)) == flat


def test_ties_capped_per_task(spark, data):
    """100 equal vectors tie for a query; each task still emits at most k."""
    Q, qids, V, vids = data
    q, v = frames(spark, Q[:1] * 0 + V[10], [1], V, vids)
    cands = knn.local_candidates(q, v.repartition(3), 5)
    per_task = cands.groupBy().count().collect()[0][0]
    assert per_task <= 5 * 3
    top = rows(knn.knn(q, v, 5))
    assert [r[2] for r in top] == sorted(int(x) for x in vids[[10] + list(range(50, 54))])


def test_fewer_vectors_than_k(spark):
    Q = np.eye(4, dtype=np.float32)
    q, v = frames(spark, Q, [0, 1, 2, 3], Q[:2], [5, 6])
    out = rows(knn.knn(q, v, 20))
    assert len(out) == 8 and max(r[1] for r in out) == 2


def test_shards_contiguous_near_equal(spark):
    for n, s in [(10, 4), (3, 16), (500, 16), (32, 16)]:
        df = spark.range(0, n)
        sv = knn.shard_vectors(df, s).toPandas().sort_values("id")
        sizes = sv.groupby("shard").size().tolist()
        exp = [len(a) for a in np.array_split(np.arange(n), s) if len(a)]
        assert sizes == exp
        assert sv["shard"].is_monotonic_increasing
        offs = knn.shard_offsets(sv.pipe(lambda p: spark.createDataFrame(p))).toPandas().sort_values("shard")
        assert (sv.id - sv.local_id).groupby(sv.shard).first().tolist() == offs["offset"].tolist()


def test_plan_uses_group_limit(spark, data):
    Q, qids, V, vids = data
    q, v = frames(spark, Q, qids, V, vids)
    df = knn.knn(q, v, 20)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


@pytest.mark.parametrize("kw", [{}, {"strategy": "vectors"}, {"strategy": "blocked", "max_broadcast_bytes": 256},
                                {"force_tiled": True, "max_broadcast_bytes": 256, "vectors_per_tile": 37}])
def test_nan_ranks_last_and_loses_nothing(spark, kw):
    rng = np.random.default_rng(1)
    V = rng.normal(size=(60, 4)).astype(np.float32)
    V[5:58, 2] = np.nan                      # fewer finite rows than k in most blocks
    Q = np.vstack([V[:2], V[5:6]])
    q, v = frames(spark, Q, [0, 1, 2], V, np.arange(60))
    got = {}
    for p, rank, i, d in ((r.prompt_id, r.rank, r.id, r.dist) for r in knn.knn(q, v, 10, **kw).collect()):
        got.setdefault(p, {})[rank] = (i, d)
    finite = [i for i in range(60) if not np.isnan(V[i]).any()]
    for p in (0, 1):
        d = {i: round(float(((V[i].astype(float) - Q[p].astype(float)) ** 2).sum()), 6) for i in finite}
        want = sorted(finite, key=lambda i: (d[i], i)) + list(range(5, 58))
        assert [got[p][r][0] for r in range(1, 11)] == want[:10]
    assert [got[2][r][0] for r in range(1, 11)] == list(range(10))     # all distances NaN: by id


def test_null_embedding_is_rejected(spark):
    v = spark.createDataFrame([(1, None), (2, [1.0])], "id long, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0])], "prompt_id long, embedding array<float>")
    with pytest.raises(Exception, match="null embedding"):
        knn.knn(q, v, 1).collect()


def test_state_of_a_task_is_bounded(spark, data, monkeypatch):
    """Candidates beyond the bound go to the merge early; the answer stays."""
    Q, qids, V, vids = data
    q, v = frames(spark, Q, qids, V, np.arange(len(V)))
    sv = knn.shard_vectors(v, 7).repartition(2).persist()
    assert rows(knn.knn_sharded(q, sv, 20)) == rows(knn.knn(q, v, 20))
    few = []

    class Batch:
        def __init__(self, at):
            self.at, self.num_rows = at, 30

        def column(self, name):
            import pyarrow as pa
            cols = {"id": np.arange(self.at, self.at + 30), "shard": np.arange(30, dtype=np.int32) % 7}
            return pa.array(list(V[self.at:self.at + 30].astype(float))) if name == "embedding" else pa.array(cols[name])

    class Shared:
        value = (qids.astype(np.int64), Q.astype(float))

    monkeypatch.setattr(knn, "MAX_HELD_ROWS", 200)
    most = 0
    for out in knn._broadcast_kernel(Shared, 20, "id", "embedding", "shard")(Batch(a) for a in range(0, 300, 30)):
        few.append(out)
        most = max(most, out.num_rows)
    assert len(few) > 7 and most <= 9 * 20


def test_block_holds_k_candidates_of_a_query_whatever_the_ties():
    """A NaN query, or one with very many equal vectors, holds no more than others."""
    import tracemalloc
    rng = np.random.default_rng(2)
    V = rng.normal(size=(4096, 8))
    V[1000:3000] = V[5]
    V[::7, 3] = np.nan
    Q = np.vstack([V[5:6], V[7:8], V[:62]])
    ids = rng.permutation(len(V))
    acc = knn._Accumulator(20)
    tracemalloc.start()
    knn._score_blocks(np.tile(Q, (16, 1)), V, ids, 20, acc)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 64 << 20               # matrices of all 1024 queries at once take 32 MB each
    qi, got, dist = (x[acc.result()[0] < len(Q)] for x in acc.result())
    for q in range(len(Q)):
        d = np.round(((V - Q[q]) ** 2).sum(axis=1), 6)
        want = sorted(range(len(V)), key=lambda i: (np.isnan(d[i]), 0 if np.isnan(d[i]) else d[i], ids[i]))[:20]
        assert got[qi == q].tolist() == ids[want].tolist()
