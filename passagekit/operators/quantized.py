"""Exact search that reads vectors at one byte per component.

Beside the full vectors, an index keeps each vector as signed bytes times a scale,
with the length of what the rounding lost. That length bounds how far the distance
to the rounded vector is from the true one, so the first pass, over the bytes
alone, gives every vector a range of distances. A vector whose smallest possible
distance exceeds the k-th smallest of the largest possible ones can't be among the
k nearest; the second pass fetches the full vectors of the others, by id from a
table laid out by id, and ranks them by their exact distance. The answer equals
the flat search.

Vectors with a NaN or infinite component have no bytes. They are kept in the full
table alone and rank last, by id; a NaN query gets the first ids.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vector import sq_l2
from ..session import scratch_path, ship_package
from ..sources import lookup
from .cells import _finite, _nan_candidates, score_tiles
from .knn import QUERY_SUBBLOCK, VECTOR_SUBBLOCK, _matrix, _rank

LEVELS = 127
_RANGES = "prompt_id long, id long, low double, high double"


@dataclass
class ByteIndex:
    codes: DataFrame              # (id, code binary, scale float, lost double)
    full: DataFrame               # (id, embedding), by id


@dataclass
class ByteSearch:
    hits: DataFrame               # (prompt_id, rank, id, dist)
    candidates: DataFrame         # (prompt_id, id) of the second pass
    index: ByteIndex


def build_byte_index(vectors: DataFrame, path: str, buckets: int = lookup.BUCKETS) -> ByteIndex:
    """Write ``vectors(id, embedding)``, ids unique, as bytes and by id."""
    spark = vectors.sparkSession
    ship_package(spark)
    cols = vectors.select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("embedding"))
    full = lookup.write_lookup(cols, f"{path}/full", "id", buckets)

    def encode(batches):
        for b in batches:
            if not b.num_rows:
                continue
            v = _matrix(b.column("embedding"))
            fine = np.flatnonzero(_finite(v))
            if not len(fine):
                continue
            v = v[fine]
            top = np.abs(v).max(axis=1, initial=0)
            scale = np.where(top > 0, top / LEVELS, 1).astype(np.float32)
            code = np.rint(v / scale[:, None].astype(np.float64)).clip(-LEVELS, LEVELS).astype(np.int8)
            lost = np.linalg.norm(v - code * scale[:, None].astype(np.float64), axis=1)
            yield pa.RecordBatch.from_pydict({"id": b.column("id").take(pa.array(fine)), "code": pa.array([c.tobytes() for c in code], pa.binary()),
                                              "scale": pa.array(scale, pa.float32()), "lost": lost})

    cols.mapInArrow(encode, "id long, code binary, scale float, lost double").write.mode("errorifexists").parquet(f"{path}/codes")
    return ByteIndex(spark.read.parquet(f"{path}/codes"), full)


def _rounded(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    code = np.frombuffer(b"".join(table["code"].to_pylist()), np.int8).reshape(table.num_rows, -1)
    return code * table["scale"].to_numpy().astype(np.float64)[:, None], table["lost"].to_numpy()


def _ranges(k: int):
    """Per tile and query, the vectors that its own k-th largest distance does
    not exclude. A block of vectors is rounded and scored at a time, against a
    block of queries at a time."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.schema([("prompt_id", pa.int64()), ("id", pa.int64()), ("low", pa.float64()), ("high", pa.float64())]).empty_table()
        if not left.num_rows or not right.num_rows:
            return empty
        q, qid = _matrix(left["embedding"]), left["prompt_id"].to_numpy()
        vid = right["id"].to_numpy()
        # the k smallest upper bounds seen so far, per query
        best = np.full((len(q), k), np.inf)
        held: dict[int, list] = {a: [] for a in range(0, len(q), QUERY_SUBBLOCK)}
        for s in range(0, len(vid), VECTOR_SUBBLOCK):
            w, lost = _rounded(right.slice(s, VECTOR_SUBBLOCK))
            wn = (w * w).sum(axis=1)
            for a, found in held.items():
                own, top = q[a:a + QUERY_SUBBLOCK], best[a:a + QUERY_SUBBLOCK]
                d = own @ w.T
                d *= -2
                d += (own * own).sum(axis=1)[:, None] + wn
                np.sqrt(np.maximum(d, 0, out=d), out=d)
                # what rounding of the sums may add, and distances compared at six digits
                slack = 1e-6 * (1 + d)
                slack += lost
                low = np.maximum(d - slack, 0)
                d += slack
                top[:] = np.partition(np.concatenate([top, d], axis=1), k - 1, axis=1)[:, :k]
                i, j = np.nonzero(low <= top.max(axis=1)[:, None])
                found.append(((i + a).astype(np.int32), (j + s).astype(np.int32), low[i, j], d[i, j]))
        parts = []
        for found in held.values():
            i, j, low, high = (np.concatenate(x) for x in zip(*found, strict=True))
            found.clear()
            keep = low <= best.max(axis=1)[i]
            parts.append(pa.table({"prompt_id": qid[i[keep]], "id": vid[j[keep]], "low": low[keep], "high": high[keep]}))
        return pa.concat_tables(parts)
    return run


def search_bytes(queries: DataFrame, index: ByteIndex, k: int = 20, **tiles) -> ByteSearch:
    """Exact top-k of ``queries(prompt_id, embedding)``."""
    spark = queries.sparkSession
    ship_package(spark)
    root = scratch_path(spark, "knn-bytes")

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("errorifexists").parquet(f"{root}/{name}")
        return spark.read.schema(df.schema).parquet(f"{root}/{name}")

    q = kept(queries.select(F.col("prompt_id").cast("long").alias("prompt_id"),
                            F.col("embedding").cast("array<float>").alias("embedding")), "queries")
    nan_query = F.exists("embedding", lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    one = F.lit(0).alias("cell")
    ranges = kept(score_tiles(q.where(~nan_query).select("prompt_id", "embedding", one), index.codes.select("id", "code", "scale", "lost", one),
                              ["code", "scale", "lost"], _ranges(k), _RANGES, **tiles), "ranges")
    by_high = Window.partitionBy("prompt_id").orderBy("high")
    limit = (ranges.select("prompt_id", "high").withColumn("at", F.row_number().over(by_high)).where(F.col("at") <= k)
             .groupBy("prompt_id").agg(F.when(F.count(F.lit(1)) >= k, F.max("high")).otherwise(F.lit(float("inf"))).alias("limit")))
    pairs = kept(ranges.join(limit, "prompt_id").where("low <= limit").select("prompt_id", "id"), "pairs")
    # pairs meet the full vectors by id, where these lie
    exact = (index.full.join(pairs, "id").withColumnRenamed("embedding", "vec").join(q, "prompt_id")
             .select("prompt_id", "id", (F.round(sq_l2(F.col("embedding"), F.col("vec")), 6) + F.lit(0.0)).alias("dist")))
    first_ids = lambda v, name: kept(v.select("id").orderBy("id").limit(k), name)
    if not q.where(nan_query).isEmpty():
        exact = exact.unionByName(_nan_candidates(q.where(nan_query), first_ids(index.full, "ids")))
    if index.codes.count() < k:
        rest = index.full.join(index.codes.select("id"), "id", "left_anti")
        exact = exact.unionByName(_nan_candidates(q.where(~nan_query), first_ids(rest, "rest")))
    return ByteSearch(_rank(exact, k, ["prompt_id"]).select("prompt_id", "rank", "id", "dist"), pairs, index)


def bytes_report(search: ByteSearch) -> DataFrame:
    """One row ``(vectors, fetched, first_bytes, second_bytes, flat_bytes)``: vector
    bytes that the two passes read, and those of a flat scan."""
    codes = search.index.codes.agg(F.count(F.lit(1)).alias("vectors"), F.sum(F.octet_length("code") + 12).alias("first_bytes"))
    dim = F.octet_length("code")
    flat = search.index.codes.agg(F.sum(dim * 4)).scalar()
    some = search.candidates.select("id").distinct().join(search.index.codes, "id")
    fetched = some.agg(F.count(F.lit(1)).alias("fetched"), F.sum(dim * 4).alias("second_bytes"))
    return codes.select("vectors", fetched.select("fetched").scalar().alias("fetched"), "first_bytes",
                        fetched.select("second_bytes").scalar().alias("second_bytes"), flat.alias("flat_bytes"))
