"""Vector search that reads a part of the vectors: exact by pruned cells, or
approximate by projection buckets.

**Cells (exact).** An index deals every vector to its nearest centroid and keeps,
per cell, the smallest and largest distance of its vectors to the cell's own
centroid and to each of a few pivots. By the triangle inequality these ranges
bound from below how near any vector of the cell can be to a query. A search
first scores, per query, the cells with the smallest bounds until they hold k
vectors; the k-th distance found is a limit that the answer cannot exceed. The
second pass scores the other cells whose bound does not exceed that limit, and
no more. The answer equals the flat search; :func:`pruned_report` says how much
each query read.

**Buckets (approximate, opt-in).** Hyperplanes cut the space; a vector's bucket is
its pattern of sides, in each of ``tables`` independent cuts. A query probes the
buckets whose sides it misses by the least, and candidates are ranked by their
exact distance. How many buckets it probes follows from a recall target, measured
on a bounded sample of queries against their exact neighbours.

Both score (cell, block) tiles: a cell's vectors and the queries that ask it are
cut into blocks by counted size, so a cell that holds a third of all vectors, or
that every query asks, is spread over many tasks. What is broadcast or collected
grows with the number of cells and the dimension alone, and is checked.

Vectors with a NaN component are kept apart and rank last, by id; a NaN query
gets the first ids, as in the flat search.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, ship_package
from .knn import _matrix, _rank, _tile_kernel, knn, tile_tasks

MAX_CELLS = 4096
PIVOTS = 32
SAMPLE = 20_000               # vectors that fit the centroids
ROUNDS = 8                    # of the centroid fit
MAX_BOUNDS_BYTES = 256 << 20  # centroids, pivots and ranges on every executor
VECTORS_PER_BLOCK = 100_000
QUERIES_PER_BLOCK = 8192
VISIT_BLOCK = 256
NO_CELL = -1                  # cell of vectors with a NaN component
TABLES, MAX_BITS = 2, 12
BUCKET_ROWS = 256             # vectors of a bucket, while MAX_BITS allows
TUNING_QUERIES = 256
_CANDIDATES = "prompt_id long, id long, dist double"


# ---------------------------------------------------------------------------
# Samples and tiles
# ---------------------------------------------------------------------------

def hashed_sample(df: DataFrame, id_col: str, n: int, total: int) -> DataFrame:
    """The ``n`` rows with the smallest id hash (all if there are no more); only
    about twice as many are sorted, whatever the table's size."""
    share = min(1.0, 2 * n / max(total, 1))
    top = min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63))
    return df.where(F.xxhash64(id_col) <= top).orderBy(F.xxhash64(id_col), id_col).limit(n)


def _finite(v: np.ndarray) -> np.ndarray:
    return np.isfinite(v).all(axis=1) if v.size else np.zeros(len(v), bool)


def score_tiles(asked: DataFrame, stored: DataFrame, columns: list[str], kernel, schema: str,
                vectors_per_block: int = VECTORS_PER_BLOCK, queries_per_block: int = QUERIES_PER_BLOCK) -> DataFrame:
    """``kernel(queries, vectors)`` over the tiles of every cell.

    ``asked(prompt_id, embedding, cell)`` and ``stored(id, cell)`` with
    ``columns``; both should be written tables, as they are counted and read.
    """
    blocks = lambda df, per, n, rows: df.groupBy("cell").agg(F.count(F.lit(1)).alias(rows)).withColumn(
        n, F.ceil(F.col(rows) / per).cast("int"))
    counted = blocks(asked, queries_per_block, "nq", "queries").join(blocks(stored, vectors_per_block, "nv", "vectors"), "cell")
    tiles, pairs = counted.agg(F.sum(F.col("nq") * F.col("nv")), F.sum(F.col("queries") * F.col("vectors").cast("double"))).first()
    sizes = counted.select("cell", "nq", "nv")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    tile = ["cell", "qb", "vb"]
    left = (asked.join(sizes, "cell").withColumn("qb", deal("prompt_id", "nq")).withColumn("vb", every("nv"))
            .select(*tile, "prompt_id", "embedding"))
    right = (stored.join(sizes, "cell").withColumn("vb", deal("id", "nv")).withColumn("qb", every("nq"))
             .select(*tile, "id", *columns))
    tasks = tile_tasks(asked.sparkSession, tiles or 1, pairs or 0)
    left, right = left.repartition(tasks, *tile), right.repartition(tasks, *tile)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return kernel(left, right)

    return left.groupBy(*tile).cogroup(right.groupBy(*tile)).applyInArrow(run, schema)


def score_cells(asked: DataFrame, stored: DataFrame, k: int, **blocks) -> DataFrame:
    """Candidates ``(prompt_id, id, dist)``: the k best of each tile."""
    return score_tiles(asked, stored, ["embedding"], _tile_kernel(k, "prompt_id", "embedding", "id", "embedding", None), _CANDIDATES, **blocks)


def _nan_candidates(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """Pairs without a distance; ``vectors`` has at most k rows."""
    ids = vectors.agg(F.collect_list("id")).scalar()
    return queries.select("prompt_id", F.explode(ids).alias("id"), F.lit(float("nan")).alias("dist"))


# ---------------------------------------------------------------------------
# Cells
# ---------------------------------------------------------------------------

@dataclass
class Bounds:
    """What a search needs to know of the cells: bounded by their number."""
    centroids: np.ndarray
    pivots: np.ndarray
    low: np.ndarray               # (cell, 1 + pivots): smallest distance to own centroid, to each pivot
    high: np.ndarray
    rows: np.ndarray              # vectors of each cell; empty cells are left out
    cells: np.ndarray             # their numbers

    def below(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower bounds of the distance from each query to each cell's vectors,
        less a margin for rounding; and distances to the centroids."""
        own, far = _distances(q, self.centroids), _distances(q, self.pivots)
        out = np.maximum(own - self.high[:, 0], self.low[:, 0] - own)
        for p in range(far.shape[1]):
            d = far[:, p, None]
            np.maximum(out, np.maximum(d - self.high[:, p + 1], self.low[:, p + 1] - d), out=out)
        return np.maximum(out - 1e-6 * (1 + own), 0), own

    def first(self, q: np.ndarray, k: int):
        """Per query its cells in order of visit, and how many hold k vectors."""
        low, own = self.below(q)
        order = np.lexsort((own, low), axis=1)
        return low, order, (np.cumsum(self.rows[order], axis=1) < k).sum(axis=1) + 1


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T)
    return np.sqrt(np.maximum(d, 0))


def fit_centroids(sample: np.ndarray, cells: int, seed: int = 0) -> np.ndarray:
    """Centroids of a sample by a few rounds of nearest-mean updates."""
    rng = np.random.default_rng(seed)
    own = np.unique(sample, axis=0)
    centroids = own[rng.permutation(len(own))[:cells]]
    for _ in range(ROUNDS):
        near = _distances(own, centroids).argmin(axis=1)
        n = np.bincount(near, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, own)
        centroids = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centroids)
    return centroids


@dataclass
class CellIndex:
    """A written index: ``vectors(id, embedding)`` in ``cell=`` folders, and the
    cells' ranges."""
    spark: SparkSession
    path: str
    bounds: Bounds = field(repr=False)

    @property
    def vectors(self) -> DataFrame:
        return _stored_cells(self.spark, self.path)


def _stored_cells(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id long, embedding array<float>, cell int").parquet(f"{path}/vectors")


def build_cell_index(vectors: DataFrame, path: str, cells: int | None = None, pivots: int = PIVOTS, seed: int = 0,
                     sample: int = SAMPLE) -> CellIndex:
    """Deal ``vectors(id, embedding)`` into cells under ``path``.

    ``cells`` defaults to the square root of the row count, at most ``MAX_CELLS``;
    centroids come from at most ``sample`` vectors, every vector is indexed.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    n = vectors.count()
    got = hashed_sample(vectors.select("id", "embedding"), "id", sample, n).toArrow()
    v = _matrix(got.column("embedding")) if got.num_rows else np.zeros((0, 1))
    v = v[_finite(v)]
    c = min(cells or max(1, round(n ** 0.5)), MAX_CELLS)
    if c * (v.shape[1] + 2 * pivots + 2) * 8 > MAX_BOUNDS_BYTES:
        raise ValueError("cell ranges over their bound: take fewer cells")
    centroids = fit_centroids(v, c, seed) if len(v) else np.zeros((0, v.shape[1]))
    # pivots far apart from one another
    chosen = [0] if len(centroids) else []
    while 0 < len(chosen) < min(pivots, len(centroids)):
        chosen.append(int(_distances(centroids, centroids[chosen]).min(axis=1).argmax()))
    far = centroids[chosen]
    shared = spark.sparkContext.broadcast((centroids, far))

    def assign(batches):
        centroids, _ = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            v = _matrix(b.column("embedding"))
            cell = np.full(len(v), NO_CELL, np.int32)
            fine = _finite(v)
            if fine.any():
                cell[fine] = _distances(v[fine], centroids).argmin(axis=1)
            yield pa.RecordBatch.from_pydict({"id": b.column("id"), "embedding": b.column("embedding"), "cell": pa.array(cell)})

    cols = vectors.select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("embedding"))
    # ranges of (cell, id): a cell with very many vectors is written by several tasks
    (cols.mapInArrow(assign, "id long, embedding array<float>, cell int").repartitionByRange("cell", "id")
     .sortWithinPartitions("cell", "id").write.mode("errorifexists").partitionBy("cell").parquet(f"{path}/vectors"))
    stored = _stored_cells(spark, path)

    def ranges(batches):
        centroids, far = shared.value
        low = np.full((len(centroids), len(far) + 1), np.inf)
        high, rows = -low, np.zeros(len(centroids), np.int64)
        for b in batches:
            cell = b.column("cell").to_numpy(zero_copy_only=False)
            fine = cell != NO_CELL
            if not fine.any():
                continue
            v, cell = _matrix(b.column("embedding"))[fine], cell[fine]
            d = np.c_[np.linalg.norm(v - centroids[cell], axis=1), _distances(v, far)]
            np.minimum.at(low, cell, d)
            np.maximum.at(high, cell, d)
            rows += np.bincount(cell, minlength=len(rows))
        c, p = np.nonzero(np.repeat(rows[:, None] > 0, len(far) + 1, axis=1))
        yield pa.RecordBatch.from_pydict({"cell": c, "p": p, "low": low[c, p], "high": high[c, p], "n": rows[c]})

    got = (stored.mapInArrow(ranges, "cell long, p long, low double, high double, n long").groupBy("cell", "p")
           .agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")))
    got.write.mode("errorifexists").parquet(f"{path}/ranges")
    spark.createDataFrame([(i, chosen.index(i) if i in chosen else None, c.tolist()) for i, c in enumerate(centroids)],
                          "cell int, pivot int, centroid array<double>").write.mode("errorifexists").parquet(f"{path}/centroids")
    return open_cell_index(spark, path)


def open_cell_index(spark: SparkSession, path: str) -> CellIndex:
    """An index written before."""
    known = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()        # at most MAX_CELLS rows
    centroids = np.array([r.centroid for r in known]) if known else np.zeros((0, 1))
    far = centroids[[r.cell for r in sorted((r for r in known if r.pivot is not None), key=lambda r: r.pivot)]]
    shape = (len(centroids), len(far) + 1)
    low, high, rows = np.full(shape, np.inf), np.full(shape, -np.inf), np.zeros(len(centroids), np.int64)
    got = spark.read.parquet(f"{path}/ranges").toArrow()             # cells x (pivots + 1) rows
    at = got.column("cell").to_numpy(), got.column("p").to_numpy()
    low[at], high[at] = got.column("low").to_numpy(), got.column("high").to_numpy()
    rows[at[0]] = got.column("n").to_numpy()
    keep = np.flatnonzero(rows)
    return CellIndex(spark, path, Bounds(centroids[keep], far, low[keep], high[keep], rows[keep], keep))


def _visits(queries: DataFrame, index: CellIndex, k: int, limits: bool) -> DataFrame:
    """``(prompt_id, embedding, cell)`` to score: the first cells of each query,
    or, with a ``limit`` column, the others that its limit cannot rule out."""
    shared = queries.sparkSession.sparkContext.broadcast(index.bounds)

    def run(batches):
        bounds = shared.value
        for b in batches:
            v = _matrix(b.column("embedding"))
            all_fine = np.flatnonzero(_finite(v)) if len(bounds.rows) else np.zeros(0, np.int64)
            # a few hundred queries at once: (queries x cells) numbers are held
            for fine in np.split(all_fine, range(VISIT_BLOCK, len(all_fine), VISIT_BLOCK)):
                if not len(fine):
                    continue
                low, order, first = bounds.first(v[fine], k)
                place = np.empty_like(order)
                np.put_along_axis(place, order, np.broadcast_to(np.arange(order.shape[1]), order.shape), axis=1)
                ask = place < first[:, None]
                if limits:
                    limit = b.column("limit").to_numpy(zero_copy_only=False)[fine]
                    # distances are compared after rounding to six digits
                    ask = ~ask & (low ** 2 <= (limit + 2e-6)[:, None])
                q, c = np.nonzero(ask)
                rows = pa.array(fine[q])
                yield pa.RecordBatch.from_pydict({"prompt_id": b.column("prompt_id").take(rows), "embedding": b.column("embedding").take(rows),
                                                  "cell": pa.array(bounds.cells[c].astype(np.int32))})

    return queries.mapInArrow(run, "prompt_id long, embedding array<float>, cell int")


@dataclass
class PrunedSearch:
    hits: DataFrame               # (prompt_id, rank, id, dist)
    visits: DataFrame             # (prompt_id, cell)
    index: CellIndex


def search_cells(queries: DataFrame, index: CellIndex, k: int = 20, **tiles) -> PrunedSearch:
    """Exact top-k of ``queries(prompt_id, embedding)`` over the index."""
    spark = queries.sparkSession
    ship_package(spark)
    root = scratch_path(spark, "knn-cells")

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("errorifexists").parquet(f"{root}/{name}")
        return spark.read.schema(df.schema).parquet(f"{root}/{name}")

    q = kept(queries.select(F.col("prompt_id").cast("long").alias("prompt_id"),
                            F.col("embedding").cast("array<float>").alias("embedding")), "queries")
    vectors = index.vectors
    asked1 = kept(_visits(q, index, k, False), "first")
    found1 = kept(score_cells(asked1, _of_cells(vectors, asked1), k, **tiles), "found")
    limit = _rank(found1, k, ["prompt_id"]).groupBy("prompt_id").agg(
        F.when(F.count(F.lit(1)) >= k, F.max("dist")).otherwise(F.lit(float("inf"))).alias("limit"))
    asked2 = kept(_visits(q.join(limit, "prompt_id"), index, k, True), "second")
    found = found1.unionByName(score_cells(asked2, _of_cells(vectors, asked2), k, **tiles))
    # what has no distance: NaN vectors where finite ones are fewer than k, and all vectors for a NaN query
    nan_query = F.exists("embedding", lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    first_ids = lambda v: kept(v.select("id").orderBy("id").limit(k), f"ids-{v is vectors}")
    if not q.where(nan_query).isEmpty():
        found = found.unionByName(_nan_candidates(q.where(nan_query), first_ids(vectors)))
    if int(index.bounds.rows.sum()) < k:
        found = found.unionByName(_nan_candidates(q.where(~nan_query), first_ids(vectors.where(F.col("cell") == NO_CELL))))
    hits = _rank(found, k, ["prompt_id"]).select("prompt_id", "rank", "id", "dist")
    visits = asked1.select("prompt_id", "cell").unionByName(asked2.select("prompt_id", "cell"))
    return PrunedSearch(hits, visits, index)


def _of_cells(vectors: DataFrame, asked: DataFrame) -> DataFrame:
    """Vectors of the cells asked: only their folders are read."""
    cells = [r[0] for r in asked.select("cell").distinct().collect()]     # at most MAX_CELLS numbers
    return vectors.where(F.col("cell").isin(cells))


def pruned_report(search: PrunedSearch) -> DataFrame:
    """``(prompt_id, cells_read, vectors_read, cells, vectors)`` per query that
    read any cell."""
    b = search.index.bounds
    spark = search.visits.sparkSession
    sizes = spark.createDataFrame([(int(c), int(n)) for c, n in zip(b.cells, b.rows, strict=True)], "cell int, n long")
    return (search.visits.join(F.broadcast(sizes), "cell").groupBy("prompt_id")
            .agg(F.count(F.lit(1)).alias("cells_read"), F.sum("n").alias("vectors_read"))
            .withColumns({"cells": F.lit(len(b.rows)).cast("long"), "vectors": F.lit(int(b.rows.sum())).cast("long")}))


# ---------------------------------------------------------------------------
# Projection buckets
# ---------------------------------------------------------------------------

@dataclass
class BucketIndex:
    """Written vectors with their bucket in each table, and the hyperplanes."""
    stored: DataFrame             # (id, embedding, codes array<int>)
    planes: np.ndarray            # (tables, bits, dim)
    center: np.ndarray
    rows: int


def _sides(v: np.ndarray, planes: np.ndarray, center: np.ndarray) -> np.ndarray:
    """Signed distances to the hyperplanes: (rows, tables, bits)."""
    return np.einsum("nd,tbd->ntb", v - center, planes)


def _codes(sides: np.ndarray) -> np.ndarray:
    return ((sides > 0) << np.arange(sides.shape[2])).sum(axis=2).astype(np.int32)


def _misses(sides: np.ndarray) -> np.ndarray:
    """How far a query of one table is off each bucket: squared distances to the
    hyperplanes that it would have to cross, (rows, buckets)."""
    out = np.zeros((len(sides), 1))
    for b in range(sides.shape[1]):
        up = np.where(sides[:, b] > 0, 0, sides[:, b] ** 2)[:, None]
        down = np.where(sides[:, b] > 0, sides[:, b] ** 2, 0)[:, None]
        out = np.concatenate([out + down, out + up], axis=1)
    return out


def build_bucket_index(vectors: DataFrame, path: str, tables: int = TABLES, bits: int | None = None, seed: int = 0,
                       sample: int = SAMPLE) -> BucketIndex:
    """Write ``vectors(id, embedding)`` with their buckets to ``path``. The
    hyperplanes are orthogonal within a table and go through the mean of at most
    ``sample`` vectors; every finite vector is indexed."""
    spark = vectors.sparkSession
    ship_package(spark)
    n = vectors.count()
    got = hashed_sample(vectors.select("id", "embedding"), "id", sample, n).toArrow()
    v = _matrix(got.column("embedding")) if got.num_rows else np.zeros((0, 1))
    v = v[_finite(v)]
    dim = v.shape[1]
    bits = min(bits or max(1, round(np.log2(max(n, 2) / BUCKET_ROWS))), MAX_BITS, dim)
    rng = np.random.default_rng(seed)
    planes = np.stack([np.linalg.qr(rng.normal(size=(dim, bits)))[0].T for _ in range(tables)])
    center = v.mean(axis=0) if len(v) else np.zeros(dim)
    shared = spark.sparkContext.broadcast((planes, center))

    def code(batches):
        for b in batches:
            if not b.num_rows:
                continue
            v = _matrix(b.column("embedding"))
            fine = np.flatnonzero(_finite(v))
            codes = _codes(_sides(v[fine], *shared.value))
            rows = pa.array(fine)
            yield pa.RecordBatch.from_pydict({"id": b.column("id").take(rows), "embedding": b.column("embedding").take(rows),
                                              "codes": pa.array(list(codes), pa.list_(pa.int32()))})

    cols = vectors.select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("embedding"))
    cols.mapInArrow(code, "id long, embedding array<float>, codes array<int>").write.mode("errorifexists").parquet(path)
    return BucketIndex(spark.read.parquet(path), planes, center, n)


def probes_for(queries: DataFrame, index: BucketIndex, k: int, recall: float, sample: int = TUNING_QUERIES) -> int:
    """Buckets per table that a query must probe to find ``recall`` of its exact
    neighbours, measured on at most ``sample`` queries."""
    spark = queries.sparkSession
    own = hashed_sample(queries, "prompt_id", sample, queries.count()).toArrow()
    tuning = spark.createDataFrame(own, "prompt_id long, embedding array<float>")
    exact = knn(tuning, index.stored.select("id", "embedding"), k)
    near = exact.select("prompt_id", "id").join(index.stored.select("id", "codes"), "id").toArrow()   # sample x k rows
    if not near.num_rows:
        return 1
    q = _matrix(own.column("embedding"))
    at = {int(p): i for i, p in enumerate(own.column("prompt_id").to_pylist())}
    who = np.array([at[p] for p in near.column("prompt_id").to_pylist()])
    codes = np.array(near.column("codes").to_pylist())
    sides = _sides(q, index.planes, index.center)
    need = np.full(len(who), np.inf)
    for t in range(index.planes.shape[0]):
        miss = _misses(sides[:, t])
        rank = np.argsort(np.argsort(miss, axis=1, kind="stable"), axis=1)
        need = np.minimum(need, rank[who, codes[:, t]])
    return int(np.quantile(need, min(recall, 1.0), method="higher")) + 1


def search_buckets(queries: DataFrame, index: BucketIndex, k: int = 20, recall: float = 0.95, probes: int | None = None,
                   **tiles) -> DataFrame:
    """Approximate top-k ``(prompt_id, rank, id, dist)``: exact distances, some
    neighbours may be missing. ``probes`` fixes the buckets per table."""
    spark = queries.sparkSession
    ship_package(spark)
    root = scratch_path(spark, "knn-buckets")
    queries.select(F.col("prompt_id").cast("long").alias("prompt_id"), F.col("embedding").cast("array<float>").alias("embedding")) \
        .where(~F.exists("embedding", lambda x: F.isnan(x) | (F.abs(x) == float("inf")))).write.mode("errorifexists").parquet(f"{root}/queries")
    q = spark.read.parquet(f"{root}/queries")
    m = probes or probes_for(q, index, k, recall)
    planes, center = index.planes, index.center
    n_tables, n_buckets = planes.shape[0], 1 << planes.shape[1]
    m = min(m, n_buckets)

    def probe(batches):
        for b in batches:
            if not b.num_rows:
                continue
            sides = _sides(_matrix(b.column("embedding")), planes, center)
            cell = []
            for t in range(n_tables):
                cell.append(np.argsort(_misses(sides[:, t]), axis=1, kind="stable")[:, :m] + t * n_buckets)
            cell = np.concatenate(cell, axis=1).astype(np.int32)
            rows = pa.array(np.repeat(np.arange(len(cell)), cell.shape[1]))
            yield pa.RecordBatch.from_pydict({"prompt_id": b.column("prompt_id").take(rows), "embedding": b.column("embedding").take(rows),
                                              "cell": pa.array(cell.ravel())})

    q.mapInArrow(probe, "prompt_id long, embedding array<float>, cell int").write.mode("errorifexists").parquet(f"{root}/asked")
    asked = spark.read.parquet(f"{root}/asked")
    stored = index.stored.select("id", "embedding", F.posexplode("codes").alias("t", "code")).select(
        "id", "embedding", (F.col("t") * n_buckets + F.col("code")).cast("int").alias("cell"))
    found = score_cells(asked, stored, k, **tiles).dropDuplicates(["prompt_id", "id"])
    return _rank(found, k, ["prompt_id"]).select("prompt_id", "rank", "id", "dist")


def recall_of(found: DataFrame, exact: DataFrame) -> DataFrame:
    """``(queries, wanted, got, recall)``: share of exact neighbours found."""
    hit = exact.select("prompt_id", "id").join(found.select("prompt_id", "id", F.lit(1).alias("hit")), ["prompt_id", "id"], "left")
    return hit.groupBy("prompt_id").agg(F.count(F.lit(1)).alias("wanted"), F.coalesce(F.sum("hit"), F.lit(0)).alias("got")).agg(
        F.count(F.lit(1)).alias("queries"), F.sum("wanted").alias("wanted"), F.sum("got").alias("got"),
        (F.sum("got") / F.sum("wanted")).alias("recall"))
