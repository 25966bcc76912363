"""Exact top-k vector search (squared L2), flat or by shard.

Result contract for every path: ``(prompt_id, rank, id, dist)`` where
``dist`` is the squared L2 distance rounded to 6 decimals and ranks order by
``(dist, id)`` -- ties always go to the lower id.

One block kernel (``topk_block``: a BLAS product, then an exact top-k cut
with ties to the lower id), four ways to feed it, chosen by measured size:

* **broadcast** -- query matrix under ``max_broadcast_bytes``: it is
  broadcast, ``mapInArrow`` scores each Arrow batch of vectors and keeps at
  most k rows per query per task; the vectors are never shuffled.
* **vectors** -- many queries, small vector table: the vectors are
  broadcast and batches of queries are scored.
* **tiled** -- both large: both sides hashed into blocks and every (query
  block, vector block) tile scored through ``cogroup().applyInArrow``, all in one
  job. The vectors are shuffled once per query block, little beside the scores.
* **blocked** (opt-in, where shuffling the vectors is worse than reading them) --
  queries are written once, then processed in blocks of at most the bound, one
  job per block, candidates appended to the shared folder (driver memory: one
  block; vectors read once per block).

Candidates from tasks/blocks/tiles are merged by ``row_number() <= k`` per
query (partial ``WindowGroupLimit`` before its exchange). No path
materialises all pairs: a batch or tile emits only its local top k, so hot
groups of equal vectors cannot blow the output up.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arith import idiv
from ..session import scratch_path, ship_package

MAX_BROADCAST_BYTES = 64 << 20     # query matrix kept on every executor
QUERY_SUBBLOCK = 128                # queries scored together in one product: a few matrices
VECTOR_SUBBLOCK = 8192              # of 128 x 8192 numbers (8 MB each) are held at once
VECTORS_PER_TILE = 200_000          # vector rows per tile on the tiled path
MAX_TILE_TASKS = 100_000
PAIRS_PER_TASK = 50_000_000         # scores that are worth a task of their own
MAX_HELD_ROWS = 1 << 21             # candidates a task holds before it hands them on

_OUT_SCHEMA = "prompt_id long, id long, dist double"
_OUT_SCHEMA_SHARD = "prompt_id long, shard int, id long, dist double"


def _matrix(col: pa.Array) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    if n == 0:
        return np.zeros((0, 0))
    if col.null_count or pc.list_flatten(col).null_count:
        raise ValueError("null embedding or component: filter or fill nulls before the search")
    vals = pc.list_flatten(col).to_numpy(zero_copy_only=False).astype(np.float64)
    return vals.reshape(n, -1)


def _select_topk(qi: np.ndarray, ids: np.ndarray, dist: np.ndarray, k: int):
    """Keep the first k of each ``qi`` group in ``(dist, id)`` order."""
    if len(qi) == 0:
        return qi, ids, dist
    order = np.lexsort((ids, dist, qi))
    qi, ids, dist = qi[order], ids[order], dist[order]
    starts = np.flatnonzero(np.r_[True, qi[1:] != qi[:-1]])
    sizes = np.diff(np.r_[starts, len(qi)])
    rank = np.arange(len(qi)) - np.repeat(starts, sizes)
    keep = rank < k
    return qi[keep], ids[keep], dist[keep]


def topk_block(Q: np.ndarray, V: np.ndarray, vids: np.ndarray, k: int):
    """Local top-k of every query row against a block of vectors.

    Returns ``(query_index, vector_id, dist)`` with at most k rows per query.
    NaN distances (a NaN component on either side) rank last, by id. Ties are
    cut here too: a query without any distance, or with very many equal ones,
    holds k candidates like any other.
    """
    if len(V) == 0 or len(Q) == 0:
        e = np.zeros(0, np.int64)
        return e, e, np.zeros(0)
    if (vids[1:] < vids[:-1]).any():
        by_id = np.argsort(vids, kind="stable")
        V, vids = V[by_id], vids[by_id]
    qn = np.einsum("ij,ij->i", Q, Q)
    vn = np.einsum("ij,ij->i", V, V)
    D = Q @ V.T
    D *= -2.0
    D += qn[:, None] + vn[None, :]
    np.maximum(D, 0.0, out=D)
    np.round(D, 6, out=D)
    D += 0.0
    kk = min(k, D.shape[1])
    if D.shape[1] > kk:
        order = np.minimum(D, np.finfo(np.float64).max)      # infinite before NaN
        order[np.isnan(order)] = np.inf
        thr = np.partition(order, kk - 1, axis=1)[:, kk - 1, None]
        keep = order <= thr
        many = np.flatnonzero(keep.sum(axis=1) > kk)
        if len(many):
            # of the vectors at the limit, those with the smallest ids
            at = order[many] == thr[many]
            room = kk - (order[many] < thr[many]).sum(axis=1)
            keep[many] &= ~at | (np.cumsum(at, axis=1, dtype=np.int32) <= room[:, None])
        qi, vi = np.nonzero(keep)
    else:
        qi, vi = np.nonzero(np.ones_like(D, dtype=bool))
    return _select_topk(qi.astype(np.int64), vids[vi].astype(np.int64), D[qi, vi], k)


class _Accumulator:
    """Running top-k per query across several blocks of one task, kept per
    sub-block of queries so that a merge touches that sub-block only."""

    def __init__(self, k: int):
        self.k = k
        self.parts: dict[int, list] = {}

    def add(self, block: int, qi, ids, dist):
        own = self.parts.setdefault(block, [])
        own.append((qi, ids, dist))
        if len(own) >= 8:
            self.parts[block] = [self._merge(own)]

    def _merge(self, parts):
        return _select_topk(*(np.concatenate(x) for x in zip(*parts, strict=True)), self.k)

    def held(self) -> int:
        return sum(len(p[0]) for parts in self.parts.values() for p in parts)

    def result(self):
        done = [self._merge(p) for _, p in sorted(self.parts.items())]
        if not done:
            e = np.zeros(0, np.int64)
            return e, e, np.zeros(0)
        return tuple(np.concatenate(x) for x in zip(*done, strict=True))


def _score_blocks(Q, V, vids, k, acc):
    """Score in sub-blocks of both sides: the distance matrix held at once has
    at most ``QUERY_SUBBLOCK x VECTOR_SUBBLOCK`` cells."""
    for v in range(0, len(V), VECTOR_SUBBLOCK):
        for s in range(0, len(Q), QUERY_SUBBLOCK):
            qi, ids, dist = topk_block(Q[s:s + QUERY_SUBBLOCK], V[v:v + VECTOR_SUBBLOCK], vids[v:v + VECTOR_SUBBLOCK], k)
            acc.add(s, qi + s, ids, dist)


def _broadcast_kernel(bc, k: int, vid: str, vcol: str, shard_col: str | None):
    def run(batches):
        qids, Q = bc.value
        accs = {}

        def hand_on():
            for key, acc in accs.items():
                qi, ids, dist = acc.result()
                cols = {"prompt_id": pa.array(qids[qi], pa.int64())}
                if shard_col is not None:
                    cols["shard"] = pa.array(np.full(len(qi), key, np.int32))
                cols["id"] = pa.array(ids, pa.int64())
                cols["dist"] = pa.array(dist, pa.float64())
                yield pa.RecordBatch.from_pydict(cols)
            accs.clear()

        for b in batches:
            if b.num_rows == 0:
                continue
            ids_all = b.column(vid).to_numpy(zero_copy_only=False).astype(np.int64)
            V_all = _matrix(b.column(vcol))
            if shard_col is None:
                groups = [(None, slice(None))]
            else:
                sh = b.column(shard_col).to_numpy(zero_copy_only=False)
                groups = [(int(s), sh == s) for s in np.unique(sh)]
            for key, sel in groups:
                acc = accs.setdefault(key, _Accumulator(k))
                _score_blocks(Q, V_all[sel], ids_all[sel], k, acc)
                # many shards or queries: what is best so far goes to the merge early
                if sum(a.held() for a in accs.values()) > MAX_HELD_ROWS:
                    yield from hand_on()
        yield from hand_on()
    return run


def _vector_broadcast_kernel(bc, k: int, qid: str, qcol: str, with_shard: bool):
    """Batches of queries against a broadcast vector matrix (final top-k per
    query per shard: every batch holds whole queries)."""
    def run(batches):
        vids, V, shards = bc.value
        groups = [(None, slice(None))] if not with_shard else [(int(x), shards == x) for x in np.unique(shards)]
        for b in batches:
            if b.num_rows == 0:
                continue
            qids = b.column(qid).to_numpy(zero_copy_only=False).astype(np.int64)
            Q = _matrix(b.column(qcol))
            for key, sel in groups:
                acc = _Accumulator(k)
                _score_blocks(Q, V[sel], vids[sel], k, acc)
                qi, ids, dist = acc.result()
                cols = {"prompt_id": pa.array(qids[qi], pa.int64())}
                if with_shard:
                    cols["shard"] = pa.array(np.full(len(qi), key, np.int32))
                cols["id"] = pa.array(ids, pa.int64())
                cols["dist"] = pa.array(dist, pa.float64())
                yield pa.RecordBatch.from_pydict(cols)
    return run


def _tile_kernel(k: int, qid: str, qcol: str, vid: str, vcol: str, shard_col: str | None):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        qids = left.column(qid).to_numpy().astype(np.int64)
        Q = _matrix(left.column(qcol))
        ids_all = right.column(vid).to_numpy().astype(np.int64)
        V_all = _matrix(right.column(vcol))
        out = []
        if shard_col is None:
            groups = [(None, slice(None))]
        else:
            sh = right.column(shard_col).to_numpy()
            groups = [(int(s), sh == s) for s in np.unique(sh)]
        for key, sel in groups:
            acc = _Accumulator(k)
            _score_blocks(Q, V_all[sel], ids_all[sel], k, acc)
            qi, ids, dist = acc.result()
            cols = {"prompt_id": pa.array(qids[qi], pa.int64())}
            if shard_col is not None:
                cols["shard"] = pa.array(np.full(len(qi), key, np.int32))
            cols["id"] = pa.array(ids, pa.int64())
            cols["dist"] = pa.array(dist, pa.float64())
            out.append(pa.table(cols))
        if not out:
            schema = [("prompt_id", pa.int64())] + ([("shard", pa.int32())] if shard_col else []) \
                + [("id", pa.int64()), ("dist", pa.float64())]
            return pa.table({n: pa.array([], t) for n, t in schema})
        return pa.concat_tables(out)
    return run


def tile_tasks(spark, tiles: int, pairs: float) -> int:
    """Tasks for ``tiles`` tiles of ``pairs`` scores: their cost is in the scores,
    not in the bytes by which Spark would merge them."""
    want = max(2 * spark.sparkContext.defaultParallelism, math.ceil(pairs / PAIRS_PER_TASK))
    return int(min(tiles, want, MAX_TILE_TASKS))


def _rank(cands: DataFrame, k: int, by: list[str]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy("dist", "id")
    return cands.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def local_candidates(queries: DataFrame, vectors: DataFrame, k: int = 20, *, qid: str = "prompt_id",
                     qcol: str = "embedding", vid: str = "id", vcol: str = "embedding",
                     shard_col: str | None = None, max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
                     vectors_per_tile: int = VECTORS_PER_TILE, strategy: str = "auto",
                     force_tiled: bool = False, scratch: str | None = None) -> DataFrame:
    """Per task/batch (and per shard if given) top-k candidates, not merged.

    ``strategy``: ``auto`` picks, by measured size, ``broadcast`` (query
    matrix under ``max_broadcast_bytes``), ``vectors`` (vector matrix under
    the bound: broadcast it and score batches of queries) or ``tiled`` (both
    sides replicated into (query block, vector block) tiles through a shuffle).
    ``blocked`` takes query blocks of at most the bound, one after the other,
    each broadcast and scanned against the vectors; candidates are appended to
    the shared folder, so the driver holds one block at a time and the vectors
    are never shuffled.
    """
    spark = queries.sparkSession
    ship_package(spark)
    if force_tiled:
        strategy = "tiled"
    schema = _OUT_SCHEMA_SHARD if shard_col else _OUT_SCHEMA
    vcols = [vid, vcol] + ([shard_col] if shard_col else [])
    stats = queries.select(F.count(F.lit(1)).alias("n"), F.max(F.size(qcol)).alias("d")).first()
    nq, dim = int(stats["n"]), int(stats["d"] or 0)
    if nq == 0:
        return spark.createDataFrame([], schema)
    qbytes = nq * max(dim, 1) * 8
    if strategy == "auto":
        if qbytes <= max_broadcast_bytes:
            strategy = "broadcast"
        elif vectors.count() * max(dim, 1) * 8 <= max_broadcast_bytes:
            strategy = "vectors"
        else:
            strategy = "tiled"

    if strategy == "broadcast":
        if qbytes > max_broadcast_bytes:
            raise ValueError("query matrix over the broadcast bound")
        # size checked above: at most max_broadcast_bytes reach the driver
        return _scan_with_queries(queries, vectors, k, qid, qcol, vid, vcol, shard_col, vcols, schema)

    if strategy == "vectors":
        nv = vectors.count()
        if nv * max(dim, 1) * 8 > max_broadcast_bytes:
            raise ValueError("vector matrix over the broadcast bound")
        vt = vectors.select(*vcols).toArrow()
        vids = vt.column(vid).to_numpy().astype(np.int64)
        V = _matrix(vt.column(vcol))
        shards = vt.column(shard_col).to_numpy() if shard_col else None
        bc = spark.sparkContext.broadcast((vids, V, shards))
        return queries.select(qid, qcol).mapInArrow(
            _vector_broadcast_kernel(bc, k, qid, qcol, shard_col is not None), schema)

    if strategy == "blocked":
        root = scratch or scratch_path(spark, "knn-blocked")
        queries.select(qid, qcol).write.mode("errorifexists").parquet(f"{root}/queries")
        stored = spark.read.parquet(f"{root}/queries")
        nqb = max(1, math.ceil(qbytes / max_broadcast_bytes))
        block = F.pmod(F.xxhash64(qid), F.lit(nqb))
        for b in range(nqb):
            part = stored.where(block == b)
            cands, bc = _scan_with_queries(part, vectors, k, qid, qcol, vid, vcol, shard_col, vcols, schema,
                                           with_broadcast=True)
            cands.write.mode("append").parquet(f"{root}/candidates")
            if bc is not None:
                bc.unpersist()   # free the block on the executors before the next one
        return spark.read.parquet(f"{root}/candidates")

    if strategy != "tiled":
        raise ValueError(f"unknown strategy {strategy}")
    nqb = max(1, math.ceil(qbytes / max_broadcast_bytes))
    nv = vectors.count()
    nvb = max(1, math.ceil(nv / vectors_per_tile))
    # block numbers have one type on both sides: the exchanges hash them
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    qrep = (queries.select(qid, qcol)
            .withColumn("_qb", deal(qid, nqb))
            .withColumn("_vb", F.explode(F.sequence(F.lit(0), F.lit(nvb - 1)))))
    vrep = (vectors.select(*vcols)
            .withColumn("_vb", deal(vid, nvb))
            .withColumn("_qb", F.explode(F.sequence(F.lit(0), F.lit(nqb - 1)))))
    tasks = tile_tasks(spark, nqb * nvb, nq * nv)
    qrep, vrep = qrep.repartition(tasks, "_qb", "_vb"), vrep.repartition(tasks, "_qb", "_vb")
    return (qrep.groupBy("_qb", "_vb").cogroup(vrep.groupBy("_qb", "_vb"))
            .applyInArrow(_tile_kernel(k, qid, qcol, vid, vcol, shard_col), schema))


def _scan_with_queries(queries, vectors, k, qid, qcol, vid, vcol, shard_col, vcols, schema,
                       with_broadcast: bool = False):
    """Collect (bounded) queries, broadcast them, score every vector batch."""
    spark = queries.sparkSession
    qt = queries.select(qid, qcol).toArrow()
    if qt.num_rows == 0:
        empty = spark.createDataFrame([], schema)
        return (empty, None) if with_broadcast else empty
    qids = qt.column(qid).to_numpy().astype(np.int64)
    Q = _matrix(qt.column(qcol))
    bc = spark.sparkContext.broadcast((qids, Q))
    out = vectors.select(*vcols).mapInArrow(_broadcast_kernel(bc, k, vid, vcol, shard_col), schema)
    return (out, bc) if with_broadcast else out


def knn(queries: DataFrame, vectors: DataFrame, k: int = 20, **kw) -> DataFrame:
    """Flat exact top-k: ``(prompt_id, rank, id, dist)``."""
    cands = local_candidates(queries, vectors, k, **kw)
    return _rank(cands, k, ["prompt_id"]).select("prompt_id", "rank", "id", "dist")


def knn_per_shard(queries: DataFrame, vectors: DataFrame, k: int = 20, shard_col: str = "shard",
                  **kw) -> DataFrame:
    """Top-k inside every shard: ``(prompt_id, shard, rank, id, dist)``."""
    cands = local_candidates(queries, vectors, k, shard_col=shard_col, **kw)
    return _rank(cands, k, ["prompt_id", "shard"]).select("prompt_id", "shard", "rank", "id", "dist")


def merge_shards(per_shard: DataFrame, k: int = 20) -> DataFrame:
    """Concatenate per-shard results and keep the overall top k."""
    return _rank(per_shard.select("prompt_id", "id", "dist"), k, ["prompt_id"]).select(
        "prompt_id", "rank", "id", "dist")


def knn_sharded(queries: DataFrame, vectors: DataFrame, k: int = 20, shard_col: str = "shard",
                **kw) -> DataFrame:
    return merge_shards(knn_per_shard(queries, vectors, k, shard_col, **kw), k)


# ---------------------------------------------------------------------------
# Shards
# ---------------------------------------------------------------------------

def shard_of(idx, n, shards: int):
    """Contiguous near-equal split of ``n`` dense ids into ``shards`` parts,
    the first ``n mod shards`` parts one longer (same rule as array_split)."""
    q = idiv(F.lit(n), shards)
    r = F.lit(n) - q * shards
    big = r * (q + 1)
    return F.when(idx < big, idiv(idx, q + 1)).otherwise(
        r + idiv(idx - big, F.greatest(q, F.lit(1)))).cast("int")


def shard_vectors(vectors: DataFrame, shards: int = 16, id_col: str = "id") -> DataFrame:
    """Add ``shard`` and ``local_id`` to vectors with dense ids 0..n-1.

    ``n`` comes from a scalar subquery (one small aggregate), so the rule is
    a per-row expression: no window, no shuffle.
    """
    n = vectors.select(F.count(F.lit(1))).scalar()
    q = idiv(n, shards)
    r = n - q * shards
    sh = shard_of(F.col(id_col), n, shards)
    start = F.when(sh < r, sh * (q + 1)).otherwise(r * (q + 1) + (sh - r) * q)
    return vectors.withColumn("shard", sh).withColumn("local_id", F.col(id_col) - start)


def shard_offsets(sharded: DataFrame) -> DataFrame:
    """``(shard, n, offset)``: running sum of shard sizes (global id of the
    shard's first row). The window runs on the tiny per-shard table."""
    sizes = sharded.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("shard", "n", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("offset"))
