"""Tables laid out by key, so that lookups by that key don't shuffle them.

A lookup table is Parquet, bucketed and sorted by its key. A join on the key
reads each bucket where it lies; only the other side, the keys asked, is shuffled
into as many buckets. Layout and bucket count are fixed when a table is written;
other sessions open it by its path.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

BUCKETS = 512


def table_name(path: str) -> str:
    return "lookup_" + hashlib.md5(path.encode()).hexdigest()[:16]


def write_lookup(df: DataFrame, path: str, key: str = "id", buckets: int = BUCKETS) -> DataFrame:
    """Write ``df`` to ``path`` by ``key``, one file per bucket; the table."""
    spark = df.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {table_name(path)}")
    (df.repartition(buckets, key).write.mode("errorifexists").bucketBy(buckets, key).sortBy(key)
     .option("path", path).saveAsTable(table_name(path)))
    return spark.table(table_name(path))


def open_lookup(spark: SparkSession, path: str, key: str = "id", buckets: int = BUCKETS) -> DataFrame:
    """A table written before, with the key and bucket count it was written with."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
    spark.sql(f"""CREATE TABLE IF NOT EXISTS {table_name(path)} ({columns}) USING parquet
        CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{path}'""")
    return spark.table(table_name(path))


def look_up(table: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``table`` whose key is among ``keys``, once each."""
    return table.join(keys.select(key).distinct(), key, "left_semi")
