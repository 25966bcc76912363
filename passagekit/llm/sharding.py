"""Uniform sharding with a hypergeometric communication matrix.

The rows are written in parts. How many rows of part i go to cell j of a shard
is drawn first: the matrix of a uniform shuffle with the given row and column
sums is a multivariate hypergeometric draw. It is never built whole: the parts
form a binary tree, and each task descends it with seeded draws to its own row.
Then each part's rows are permuted locally and dealt out by that row, exchanged
to their cells, and permuted again inside the cell. Shard sizes are exact
(equal counts, at most one apart) and every assignment is equally likely up to
the generator.

A shard consists of cells, of about ``cell_rows`` rows while that makes at most
``MAX_CELLS`` cells in all, larger ones (sorted on disk) beyond: the column sums
that every task gets stay below half a megabyte, and neither permutation holds a
shard in one task. The assignment depends on the written part and the
row's place in it, so a lost executor's rows are dealt again in the same way.

Defined results: nulls in any column are carried along (a null text has size 1,
checksum that of the empty text); repeated rows are dealt separately; an empty
table gives an empty result; extra columns pass through unless they have one of
the output names, which are then replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path, ship_package
from .common import documents

SHARDS = 8
CELL_ROWS = 1 << 10
MAX_CELLS = 1 << 16          # cells of all shards: bounds the broadcast and each task's draws
PART_ROWS = 100_000          # rows of a written part: bounds the local permutation
MAX_PARTS = 1 << 22          # names and sizes of parts that every task gets: bounds that broadcast
LIMIT = 10 ** 9              # of numpy's exact draws
OUT = ["law", "shard", "slot", "grown_shard"]


def balanced(n: int, k: int) -> np.ndarray:
    """n things in k lots, at most one apart, larger lots first."""
    return np.full(k, n // k, np.int64) + (np.arange(k) < n % k)


def _hypergeometric(rng, good: int, bad: int, draws: int) -> int:
    """Exact draw. Beyond numpy's limit by inversion: the odds of neighbouring
    counts are exact ratios, their running products from the mode outwards give
    all odds down to 1e-30 of the largest."""
    if draws == 0 or good == 0:
        return 0
    if bad == 0:
        return draws
    if max(good, bad) < LIMIT:
        return int(rng.hypergeometric(good, bad, draws))
    n = good + bad
    low, high = max(0, draws - bad), min(good, draws)
    mode = min(max((draws + 1) * (good + 1) // (n + 2), low), high)
    reach = int(12 * (draws / n * good * (bad / n) * ((n - draws) / max(n - 1, 1))) ** 0.5) + 100
    up = np.arange(mode, min(high, mode + reach), dtype=np.float64)
    down = np.arange(mode, max(low, mode - reach), -1, dtype=np.float64)
    # odds of k + 1 to k, and of k - 1 to k
    rise = np.log((good - up) * (draws - up)) - np.log((up + 1) * (bad - draws + up + 1))
    fall = np.log(down * (bad - draws + down)) - np.log((good - down + 1) * (draws - down + 1))
    odds = np.exp(np.r_[np.cumsum(fall)[::-1], 0.0, np.cumsum(rise)])
    total = np.cumsum(odds)
    return int(mode - len(down) + np.searchsorted(total, rng.random() * total[-1], side="right"))


def split_counts(rng, cells: np.ndarray, draws: int) -> np.ndarray:
    """Multivariate hypergeometric: ``draws`` places out of ``cells``. Places of
    more than numpy's limit are drawn for groups of cells first."""
    if cells.sum() < LIMIT:
        return rng.multivariate_hypergeometric(cells, draws, method="marginals")
    groups = (np.cumsum(cells) - cells) // (LIMIT // 2)
    out, rest, left = np.zeros_like(cells), int(cells.sum()), draws
    for g in np.unique(groups):
        own = np.flatnonzero(groups == g)
        size = int(cells[own].sum())
        rest -= size
        k = _hypergeometric(rng, size, rest, left)
        left -= k
        if len(own) == 1:
            out[own] = k
        else:
            out[own] = split_counts(rng, cells[own], k) if size < LIMIT else _one_by_one(rng, cells[own], k)
    return out


def _one_by_one(rng, cells: np.ndarray, draws: int) -> np.ndarray:
    out, rest = np.zeros_like(cells), int(cells.sum())
    for i, c in enumerate(cells.tolist()):
        rest -= c
        out[i] = _hypergeometric(rng, c, rest, draws)
        draws -= out[i]
    return out


def matrix_row(parts: np.ndarray, cells: np.ndarray, i: int, seed: int) -> np.ndarray:
    """Row i of the communication matrix with row sums ``parts`` and column sums
    ``cells``; the rows of all i add up to ``cells``."""
    lo, hi, have = 0, len(parts), np.asarray(cells, np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, lo, hi])
        left = split_counts(rng, have, int(parts[lo:mid].sum()))
        if i < mid:
            hi, have = mid, left
        else:
            lo, have = mid, have - left
    return have


def shard_rows(docs: DataFrame, n_shards: int = SHARDS, seed: int = 0, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``docs`` plus ``law``, ``shard`` (0 to n_shards - 1), ``slot`` (gapless
    place in the shard) and ``grown_shard`` (null: this law moves all rows)."""
    spark = docs.sparkSession
    docs = docs.drop(*OUT)
    path = scratch_path(spark, "parts")
    docs.write.option("maxRecordsPerFile", PART_ROWS).mode("errorifexists").parquet(path)
    rows = (spark.read.schema(docs.schema).parquet(path)
            .select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                    F.col("_metadata.file_name").alias("part"), F.col("_metadata.row_index").alias("place")))
    # the driver sees one number per written part
    files = sorted((r[0], r[1]) for r in rows.groupBy("part").agg(F.count(F.lit(1))).collect())
    if len(files) > MAX_PARTS:
        raise ValueError("too many parts: raise PART_ROWS")
    n = sum(c for _, c in files)
    sizes = balanced(n, n_shards)
    per = max(1, min(-(-int(sizes.max()) // cell_rows), MAX_CELLS // n_shards))
    cells = np.concatenate([balanced(int(s), per) for s in sizes])
    shared = spark.sparkContext.broadcast(({f: i for i, (f, _) in enumerate(files)},
                                           np.array([c for _, c in files], np.int64), cells, seed))
    ship_package(spark)

    @F.pandas_udf("cell long, lot long")
    def deal(rows: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        index, counts, cells, seed = shared.value
        name, to, lots = None, None, None
        for names, places in rows:
            out = np.zeros((2, len(names)), np.int64)
            for f in names.unique():
                if f != name:
                    name, (to, lots) = f, local_deal(counts, cells, index[f], seed)
                at = (names == f).to_numpy()
                out[:, at] = to[places[at].to_numpy()], lots[places[at].to_numpy()]
            yield pd.DataFrame({"cell": out[0], "lot": out[1]})

    dealt = rows.withColumn("to", deal("part", "place")).select("row", "place", "to.cell", "to.lot")
    # the exchange, and the second permutation inside each cell
    rank = F.row_number().over(Window.partitionBy("cell").orderBy("lot", "place")) - 1
    shard, j = F.expr(f"cell div {per}"), F.col("cell") % per
    size = F.lit(n // n_shards) + (shard < n % n_shards).cast("long")
    offset = j * F.floor(size / F.lit(per)).cast("long") + F.least(j, size % per)
    return dealt.select("row.*", F.lit("rows").alias("law"), shard.cast("int").alias("shard"),
                        (offset + rank).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def local_deal(counts, cells, i: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Cell of each row of part i (first permutation), and the lot it draws for
    its place there (a random 62-bit number: the second permutation)."""
    rng = np.random.default_rng([seed, len(counts), i])
    to = np.repeat(np.arange(len(cells)), matrix_row(counts, cells, i, seed))
    return to[rng.permutation(len(to))], rng.integers(0, 1 << 62, len(to))


def op5_sharding(spark, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = documents(spark, sf_dir).select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"))
    return shard_rows(docs).select("doc_id", "size", "text_crc32", *OUT)
