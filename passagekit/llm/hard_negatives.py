"""Hard negatives by exact integer scores in a residue number system.

Components become integers. A tile of (anchors x rows) is scored by one float32
matrix product per small prime: residues lie within half the prime and a product
runs over at most ``CHUNK`` dimensions, so every partial sum stays below 2^24,
where float32 is exact. Balanced mixed-radix digits (Chinese remaindering)
rebuild the signed score; as many primes are taken as the largest possible
score, the largest squared norm, needs four times over.

Two passes over the same grid of tiles: the first keeps each tile's best
``n_pos`` rows of an anchor's own label, and a window over the tiles' bests
chooses the positives; the second keeps, per anchor and positive, each tile's
best ``n_neg`` rows of other labels inside the positive's score window, and the
same kind of window selects among them. Blocks of rows and of anchors are dealt
by the hash of a key that staging gives each row, so no id, label or group of
equal rows weighs on one tile. A tile hands on its bests alone; within a tile,
rows come by id, and after the bests are full only strictly higher scores enter,
so groups of ties add nothing. Both sides of the grid are shuffled: nothing is
broadcast or collected but counts.

Defined results: rows with a null label, a null vector or a null or non-finite
component take no part; vectors of different length count as padded with zeros;
a null id is never an anchor and comes last among ties; every row counts as
itself, so repeated rows are candidates each, a repeated anchor gives its result
once per repeat, and the "other rows" of an anchor are all rows but that very
one; equal ids and scores are put in order of their staging key, which has no
meaning; an empty table, or one without anchors, gives an empty result; extra
columns are ignored whatever their names. A table whose scores may leave a long
is an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package
from .common import arrow_map, staged, table

SCALE = 256
N_POS, N_NEG = 5, 10
LOW, HIGH = 30, 90            # window of a negative's score, in hundredths of the positive's
CHUNK = 64                    # dimensions of one float32 product
PRIME_TOP = 1024              # primes below: 64 * 511^2 < 2^24
TILE_ANCHORS = 4096
TILE_BYTES = 32 << 20         # integer rows of a tile
MIN_TILE_ROWS = 1024          # smaller tiles than this gain nothing
BLOCK = 256                   # anchors scored at once
ROW_CHUNK = 4096              # rows scored at once
OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


# ---- residue number system --------------------------------------------------------

def primes_for(bound: int) -> list[int]:
    """Largest primes below ``PRIME_TOP`` whose product exceeds ``4 * bound``."""
    found, product = [], 1
    for p in range(PRIME_TOP - 1, 2, -1):
        if all(p % q for q in range(2, int(p ** 0.5) + 1)):
            found.append(p)
            product *= p
            if product > 4 * bound and len(found) >= 2:
                return found
    raise ValueError("scores beyond the residue system")


def nearest(v: np.ndarray, p: int) -> np.ndarray:
    """Balanced residue of exact float32 integers (a value at the very edge may
    come out as its congruent neighbour, which later digits absorb)."""
    return v - np.float32(p) * np.rint(v * np.float32(1.0 / p))


def residues(x: np.ndarray, primes: list[int]) -> list[np.ndarray]:
    out = []
    for p in primes:
        r = x % p
        out.append((r - p * (r > p // 2)).astype(np.float32))
    return out


def products(a: list[np.ndarray], b: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """Exact signed ``A @ B.T`` from the residues of A and B."""
    dim, digits = a[0].shape[1], []
    total, weight = np.zeros((len(a[0]), len(b[0])), np.int64), 1
    for i, p in enumerate(primes):
        s = np.float32(0)
        for d in range(0, max(dim, 1), CHUNK):
            s = nearest(s + nearest(a[i][:, d:d + CHUNK] @ b[i][:, d:d + CHUNK].T, p), p)
        # the digit of radix p: what the earlier digits leave, over their radices
        for v, q in zip(digits, primes, strict=False):
            s = nearest(nearest(s - v, p) * np.float32(_balanced(pow(q, -1, p), p)), p)
        digits.append(s)
        total += s.astype(np.int64) * weight
        weight *= p
    return total


def _balanced(r: int, p: int) -> int:
    return r - p if r > p // 2 else r


# ---- tiles ------------------------------------------------------------------------

def _matrix(col, dim: int, pad: int = 0) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    sizes = pc.list_value_length(col).to_numpy(zero_copy_only=False)
    out = np.full((len(col), dim), pad, np.int64)
    out[np.arange(dim) < sizes[:, None]] = pc.list_flatten(col).to_numpy(zero_copy_only=False)
    return out


def _numbers(col, none: int) -> np.ndarray:
    return np.asarray(pc.fill_null(col, none).to_numpy(), np.int64)


class Bests:
    """First k rows (higher scores first, then earlier rows) per query of a
    block, fed with chunks of rows in order."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.floor = np.full(n, np.iinfo(np.int64).min)     # a score must exceed it once k rows are held
        self.full = np.zeros(n, bool)
        self.q = self.row = self.score = np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ok: np.ndarray, at: int) -> None:
        q, row = np.nonzero(ok & ((scores > self.floor[:, None]) | ~self.full[:, None]))
        if not len(q):
            return
        s = scores[q, row]
        q, row, s = np.r_[self.q, q], np.r_[self.row, row + at], np.r_[self.score, s]
        order = np.lexsort((row, -s, q))
        q, row, s = q[order], row[order], s[order]
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        sizes = np.diff(np.r_[first, len(q)])
        rank = np.arange(len(q)) - np.repeat(first, sizes)
        keep = rank < self.k
        self.q, self.row, self.score = q[keep], row[keep], s[keep]
        last = rank == self.k - 1
        self.floor[q[last]], self.full[q[last]] = s[last], True


def _chunks(n: int):
    """Growing ranges: the first rows fill the bests cheaply."""
    at, size = 0, 64
    while at < n:
        yield at, min(n, at + size)
        at, size = at + size, min(2 * size, ROW_CHUNK)


def _tile(left: pa.Table, right: pa.Table, dim: int, primes: list[int], k: int, windows: bool) -> dict:
    """Bests of one tile; ``windows``: per positive of an anchor, else per anchor."""
    rid = _numbers(right["id"], np.iinfo(np.int64).max)
    rkey = _numbers(right["key"], 0)
    order = np.lexsort((rkey, pc.is_null(right["id"]).to_numpy(), rid))
    rkey, label = rkey[order], _numbers(right["label"], 0)[order]
    x = _matrix(right["x"], dim)[order]
    a, akey, alabel = _matrix(left["x"], dim), _numbers(left["key"], 0), _numbers(left["label"], 0)
    out = {"akey": [], "slot": [], "key": [], "score": []}
    slots = 1
    if windows:
        # a missing positive's window, 0 to -1, holds no score
        slots = int(pc.max(pc.list_value_length(left["low"])).as_py())
        lows, highs = _matrix(left["low"], slots), _matrix(left["high"], slots, -1)
    for lo in range(0, len(a), BLOCK):
        own = slice(lo, lo + BLOCK)
        ra, n = residues(a[own], primes), len(a[own])
        bests = [Bests(n, k) for _ in range(slots)]
        for s, e in _chunks(len(x)):
            scores = products(ra, residues(x[s:e], primes), primes)
            same = alabel[own][:, None] == label[None, s:e]
            if not windows:
                bests[0].add(scores, same & (akey[own][:, None] != rkey[None, s:e]), s)
                continue
            for j in range(slots):
                ok = ~same & (scores >= lows[own, j][:, None]) & (scores <= highs[own, j][:, None])
                bests[j].add(scores, ok, s)
        for j, b in enumerate(bests):
            out["akey"].append(akey[own][b.q])
            out["slot"].append(np.full(len(b.q), j))
            out["key"].append(order[b.row])
            out["score"].append(b.score)
    got = {c: pa.array(np.concatenate(v) if v else np.zeros(0, np.int64)) for c, v in out.items()}
    at = got.pop("key")
    return {**got, "key": right["key"].combine_chunks().take(at), "id": right["id"].combine_chunks().take(at)}



def _grid(anchors: DataFrame, rows: DataFrame, grid: tuple[int, int], dim: int, primes: list[int], k: int,
          windows: bool) -> DataFrame:
    """``(akey, slot, key, id, score)``: the bests of every tile."""
    n_a, n_r = grid
    deal = lambda n: F.pmod(F.xxhash64("key"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # as many tasks as tiles: their cost is in the scores, not in the bytes
    left = anchors.withColumn("ab", deal(n_a)).withColumn("rb", every(n_r)).repartition(n_a * n_r, "ab", "rb")
    right = rows.withColumn("rb", deal(n_r)).withColumn("ab", every(n_a)).repartition(n_a * n_r, "ab", "rb")
    schema = pa.schema([("akey", pa.int64()), ("slot", pa.int32()), ("key", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        got = _tile(left, right, dim, primes, k, windows)
        return pa.table([got[f.name].cast(f.type) for f in schema], schema=schema)

    return (left.groupBy("ab", "rb").cogroup(right.groupBy("ab", "rb"))
            .applyInArrow(run, "akey long, slot int, key long, id long, score long"))


def _first(bests: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("akey", "slot").orderBy(F.desc("score"), F.asc_nulls_last("id"), "key")
    return bests.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


# ---- operator -----------------------------------------------------------------------

def hard_negatives(vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", label_col: str | Column = "label",
                   vector_col: str = "embedding", scale: int = SCALE, n_pos: int = N_POS, n_neg: int = N_NEG,
                   low: int = LOW, high: int = HIGH, tile_anchors: int = TILE_ANCHORS, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """Negatives per anchor and positive; see the module. ``is_anchor`` is a
    condition over ``id`` (the row's id)."""
    spark = vectors.sparkSession
    ship_package(spark)
    label = F.col(label_col) if isinstance(label_col, str) else label_col
    rows = staged(integer_rows(vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"),
                                              F.col(vector_col).alias("c")), scale)
                  .withColumn("key", F.monotonically_increasing_id()), "negatives_rows")
    n, dim, bound = rows.agg(F.count(F.lit(1)), F.max(F.size("x")), F.max("norm")).first()
    empty = spark.createDataFrame([], OUT)
    if not n:
        return empty
    if bound >= 2.0 ** 62:
        raise ValueError("scores leave a long: use a smaller scale")
    primes, dim = primes_for(int(bound) + 1), max(int(dim), 1)
    rows = rows.drop("norm")
    anchors = staged(rows.where(F.coalesce(is_anchor, F.lit(False))), "negatives_anchors")
    n_anchors = anchors.count()
    if not n_anchors:
        return empty
    most = max(MIN_TILE_ROWS, tile_bytes // (8 * dim))
    grid = (-(-n_anchors // tile_anchors),
            max(-(-n // most), min(-(-n // MIN_TILE_ROWS), 3 * spark.sparkContext.defaultParallelism)))

    positives = staged(_first(_grid(anchors, rows, grid, dim, primes, n_pos, False), n_pos)
                       .select("akey", F.col("rank").alias("pos"), F.col("id").alias("positive_id"),
                               F.col("score").alias("positive_score")), "positives")
    # integer bounds of low * p <= 100 * s <= high * p; products of a long and a percentage need 38 digits
    part = lambda pct, up: F.expr(
        f"cast({'ceil' if up else 'floor'}(cast(positive_score as decimal(20,0)) * {pct} / 100) as long)")
    windows = positives.groupBy("akey").agg(F.sort_array(F.collect_list(F.struct(
        "pos", part(low, True).alias("low"), part(high, False).alias("high")))).alias("w"))
    asked = (anchors.join(windows, anchors["key"] == windows["akey"])
             .select("key", "id", "label", "x", F.col("w.low").alias("low"), F.col("w.high").alias("high")))
    asked = staged(asked, "negatives_asked")
    found = _first(_grid(asked, rows.select("key", "id", "label", "x"), grid, dim, primes, n_neg, True), n_neg)
    ids = anchors.select(F.col("key").alias("akey"), F.col("id").alias("anchor_id"))
    return (found.withColumn("pos", F.col("slot") + 1).withColumnRenamed("id", "negative_id").withColumnRenamed("score", "negative_score")
            .join(positives, ["akey", "pos"]).join(ids, "akey")
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))


def integer_rows(cols: DataFrame, scale: int) -> DataFrame:
    """``(id, label, x array<long>, norm double)`` of the rows that take part."""
    def run(batches):
        for b in batches:
            col = b.column("c")
            sizes = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            c = np.floor(pc.list_flatten(col).cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False) * scale)
            ends = np.cumsum(sizes)
            bad = np.r_[0, np.cumsum(~np.isfinite(c))]
            keep = (bad[ends] == bad[ends - sizes]) & ~pc.is_null(col).to_numpy(zero_copy_only=False) \
                & ~pc.is_null(b.column("label")).to_numpy(zero_copy_only=False)
            c, sizes = c[np.repeat(keep, sizes)], sizes[keep]
            rows = np.repeat(np.arange(len(sizes)), sizes)
            norm = np.bincount(rows, c * c, len(sizes))
            x = np.clip(c, -2.0 ** 62, 2.0 ** 62).astype(np.int64)   # beyond, ``norm`` ends the job
            mask = pa.array(keep)
            yield {"id": b.column("id").filter(mask), "label": b.column("label").filter(mask), "norm": norm,
                   "x": pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(x))}

    return arrow_map(cols, run, "id long, label long, x array<long>, norm double")


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label_col=label)


ORACLE = """
with t as (select vec_id, label, list_transform(embedding, lambda c: cast(floor(256 * cast(c as double)) as bigint)) as x
           from embeddings
           where label is not null and embedding is not null
             and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
     r as (select vec_id, x, cast(case when vec_id % 7 = 0 then (label + 1) % 10 else label end as bigint) as label from t),
     s as (select a.vec_id as anchor_id, a.label = b.label as same, b.vec_id,
                  cast(list_sum(list_transform(list_zip(a.x, b.x), lambda z: z[1] * z[2])) as bigint) as score
           from r a, r b where a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
     p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same
           qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select anchor_id, positive_id,
       cast(row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) as integer) as rank,
       vec_id as negative_id, positive_score, score as negative_score
from p join s using (anchor_id)
where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
qualify row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) <= 10
"""
