"""Helpers shared by the training-data operators."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path, ship_package, table

# Word separators of every contract: space and the ASCII controls 9 to 13.
# ``bytes.split()`` without arguments splits on exactly these.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
WORD = "[^\\x20\\x09-\\x0D]+"

__all__ = ["SPACES", "WORD", "staged", "documents", "arrow_map", "whole_groups", "bits_of", "has_bits", "connected_components", "in_sample", "table"]


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts lineage,
    fixes the rows against recomputation, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def arrow_map(df: DataFrame, fn, schema: str) -> DataFrame:
    """``mapInArrow`` over a generator of column dicts.

    ``fn(batches)`` yields dicts of arrays named as in ``schema``; the output
    types are those of ``schema``.
    """
    ship_package(df.sparkSession)
    fields = T._parse_datatype_string(schema)
    arrow = pa.schema([pa.field(f.name, _arrow(f.dataType)) for f in fields])

    def run(batches):
        for cols in fn(batches):
            arrays = []
            for f in arrow:
                c = cols[f.name]
                arrays.append(c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type))
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.mapInArrow(run, fields)


def _arrow(t: T.DataType) -> pa.DataType:
    simple = {T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.StringType: pa.string(),
              T.BinaryType: pa.binary(), T.BooleanType: pa.bool_(), T.DoubleType: pa.float64()}
    if isinstance(t, T.ArrayType):
        return pa.list_(_arrow(t.elementType))
    return simple[type(t)]


def whole_groups(batches, cols: list[str], n_keys: int):
    """Numpy columns of sorted batches, regrouped so that no group of equal
    leading ``n_keys`` columns is split; holds one batch and one group."""
    import numpy as np
    held: list = []
    for b in batches:
        if not b.num_rows:
            continue
        new = [b.column(c).to_numpy(zero_copy_only=False) for c in cols]
        same = np.ones(b.num_rows, bool)
        for k in new[:n_keys]:
            same &= k == k[-1]
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut == 0 and held and all(h[-1] == k[-1] for h, k in zip(held[-1][:n_keys], new[:n_keys], strict=True)):
            held.append(new)
            continue
        held.append([x[:cut] for x in new])
        yield [np.concatenate(x) for x in zip(*held, strict=True)]
        held = [[x[cut:] for x in new]]
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def in_sample(ids: DataFrame, col: str, sample: int) -> Column:
    """Condition that holds for about ``2 * sample`` distinct values of ``col``,
    those with the smallest hash (for all values if there are no more): what is
    left to sort for the first ``sample`` doesn't grow with the table."""
    n = ids.agg(F.approx_count_distinct(col)).first()[0]
    share = min(1.0, 2 * sample / max(n, 1))
    return F.xxhash64(col) <= min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63))


# ---- fixed-size key filters -------------------------------------------------

FILTER_BITS = 1 << 26        # 8 MB at least,
MAX_FILTER_BITS = 1 << 29    # 64 MB at most whatever the input: the proven broadcast bound
BITS_PER_KEY = 8


def bits_of(keys: DataFrame, col: str, n_bits: int | None = None):
    """Broadcast bitmap of ``key mod n_bits`` over a long column; the number of
    bits follows that of the keys within its bounds.

    At most ``MAX_FILTER_BITS / 8`` bytes reach the driver whatever the number of
    keys; with more keys the filter only lets more rows through.
    """
    import numpy as np
    if n_bits is None:
        n = BITS_PER_KEY * keys.count()
        n_bits = min(max(FILTER_BITS, 1 << max(n - 1, 1).bit_length()), MAX_FILTER_BITS)
    pos = F.pmod(F.col(col), F.lit(n_bits)) + 1       # bitmap functions count from 1
    rows = (keys.where(F.col(col).isNotNull()).select(pos.alias("p"))
            .groupBy(F.expr("bitmap_bucket_number(p)").alias("b"))
            .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("m")).collect())
    out = np.zeros(n_bits // 8, np.uint8)
    step = 4096
    for r in rows:
        at = (int(r["b"]) - 1) * step
        out[at:at + step] = np.frombuffer(bytes(r["m"]), np.uint8)[:max(0, len(out) - at)]
    return keys.sparkSession.sparkContext.broadcast(out)


def has_bits(bitmap, keys):
    """Boolean per key (int64 array): may be in the filter (no false negatives)."""
    import numpy as np
    pos = np.mod(keys, len(bitmap) * 8)
    return (bitmap[pos >> 3] >> (pos & 7).astype(np.uint8)) & 1 == 1


# ---- connected components -----------------------------------------------------

def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, root)`` for every node of ``edges``; root is the smallest node
    value of its component.

    Alternating large-star and small-star rounds over written tables: each
    node's smallest neighbour comes from a partial aggregate, and the joins
    are plain two-sided shuffles whose hot keys Spark splits. Rounds grow with
    the logarithm of the diameter.
    """
    e = (edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
         .where(F.col("u") != F.col("v")).distinct())
    e, seen = staged(e, "edges"), None
    while True:
        mark = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = mark
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = staged(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "low")
        large = staged(both.join(low, "u").where(F.col("v") > F.col("u"))
                       .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        low = staged(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = (large.join(low, "u").where(F.col("v") != F.col("m"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v")))
        e = staged(small.unionByName(low.select("u", F.col("m").alias("v")))
                   .where(F.col("u") != F.col("v")).distinct(), "edges")
