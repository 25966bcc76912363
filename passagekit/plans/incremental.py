"""Corpus that grows by batches: only new texts are hashed, parsed and written.

A store is a folder with

* ``seen``: the hash of every text taken so far, bucketed and sorted by hash,
  one partition per batch. A new batch's hashes meet it by a join on the bucket
  column: the store's side is read as it lies, without an exchange, and only the
  batch is shuffled, into as many buckets. Where the scan is large, Spark sends a
  Bloom filter of the batch's hashes ahead of it.
* ``sections``: the sections taken, one folder per batch, inside it by ``file``.
* ``log``: one row per finished batch, with the numbers to go on from. It is
  written last, so a batch counts as a whole or not at all; what a killed run
  left behind is replaced when the batch is run again, and a batch that the log
  already has is skipped.

Ids go on where the last batch ended, so batches taken in order give what one
build over all of them gives.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arith import idiv
from ..operators import corpus
from ..session import scratch_path
from . import corpus_build

BUCKETS = 512                 # fixed when a store is made
SECTION_COLUMNS = ["id", "text", "first_sentence", "file", "id1", "doc_id", "sec"]
_LOG = "batch int, original long, kept long, next_id1 long, next_id long, rows_per_file int, buckets int"


@dataclass
class Store:
    spark: SparkSession
    path: str
    rows_per_file: int = corpus.ROWS_PER_FILE
    buckets: int = BUCKETS

    def __post_init__(self):
        """Opens the store, and makes it if there is none."""
        fresh = self.spark.createDataFrame([], _LOG)
        fresh.write.mode("ignore").parquet(f"{self.path}/log")
        first = self.log().orderBy("batch").first()
        if first is not None:
            self.rows_per_file, self.buckets = first.rows_per_file, first.buckets
        self.table = "seen_" + hashlib.md5(self.path.encode()).hexdigest()[:16]
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/seen")
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(folder)
        self.spark.sql(f"""CREATE TABLE IF NOT EXISTS {self.table} (h STRING, batch INT) USING parquet
            PARTITIONED BY (batch) CLUSTERED BY (h) SORTED BY (h) INTO {self.buckets} BUCKETS LOCATION '{self.path}/seen'""")
        self.spark.sql(f"ALTER TABLE {self.table} RECOVER PARTITIONS")

    def log(self) -> DataFrame:
        return self.spark.read.schema(_LOG).parquet(f"{self.path}/log")

    def seen(self) -> DataFrame:
        """Hashes of finished batches: ``(h, batch)``."""
        done = [r.batch for r in self.log().select("batch").collect()]
        return self.spark.table(self.table).where(F.col("batch").isin(done))

    def sections(self) -> DataFrame:
        """The corpus: sections of finished batches."""
        done = [r.batch for r in self.log().select("batch").collect()]
        schema = "id long, text string, first_sentence string, id1 long, doc_id long, sec int, batch int, file int"
        return (self.spark.read.schema(schema).option("basePath", f"{self.path}/sections").parquet(f"{self.path}/sections")
                .where(F.col("batch").isin(done)).select(*SECTION_COLUMNS)) if done else \
            self.spark.createDataFrame([], schema).select(*SECTION_COLUMNS)


def new_hashes(store: Store, first: DataFrame) -> DataFrame:
    """Those of the batch's texts ``first(h, id1)``, one row per hash, that the
    store has not seen. ``first`` should be a written table."""
    # a selective condition on the batch lets Spark derive the filter on the store's scan
    asked = first.where(F.length("h") == 64).select("h")
    known = store.seen().select("h").join(asked, "h", "left_semi").distinct()
    return first.join(known, "h", "left_anti")


def add_batch(store: Store, articles: DataFrame, batch: int, rows_per_range: int = 4_000_000) -> bool:
    """Take ``articles(doc_id, text)`` as batch number ``batch``; False if the store
    has it already. Batches come in the order of their numbers."""
    spark = store.spark
    last = store.log().orderBy(F.desc("batch")).first()
    if last is not None and batch <= last.batch:
        if not store.log().where(F.col("batch") == batch).isEmpty():
            return False
        raise ValueError("batches come in the order of their numbers")
    next_id1, next_id = (last.next_id1, last.next_id) if last is not None else (0, 0)
    scratch = scratch_path(spark, f"batch-{batch}")
    staged = corpus_build.stage_sections(articles, f"{scratch}/staged")
    ids1 = corpus.dense_index_ranges(staged.select("doc_id", "sec", "h"), ["doc_id", "sec"], "id1", f"{scratch}/ids1", rows_per_range)
    ids1.withColumn("id1", F.col("id1") + next_id1).write.mode("errorifexists").parquet(f"{scratch}/keys")
    keys = spark.read.parquet(f"{scratch}/keys")
    # copies inside the batch collapse on the map side, before any join
    keys.groupBy("h").agg(F.min("id1").alias("id1")).write.mode("errorifexists").parquet(f"{scratch}/first")
    new_hashes(store, spark.read.parquet(f"{scratch}/first")).write.mode("errorifexists").parquet(f"{scratch}/new")
    fresh = spark.read.parquet(f"{scratch}/new")
    ids2 = corpus.dense_index_ranges(fresh, ["id1"], "id", f"{scratch}/ids2", rows_per_range)
    (keys.select("doc_id", "sec", "id1").join(ids2.select("id1", (F.col("id") + next_id).alias("id")), "id1")
     .withColumn("file", idiv("id1", store.rows_per_file).cast("int"))
     .write.mode("errorifexists").parquet(f"{scratch}/survivors"))
    survivors = spark.read.parquet(f"{scratch}/survivors")
    corpus_build.write_sections_colocated(staged, survivors, f"{store.path}/sections/batch={batch}")
    # replaces this batch's partition alone, whatever an earlier attempt left in it
    mode = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        fresh.select("h", F.lit(batch).alias("batch")).repartition(store.buckets, "h").write.insertInto(store.table, overwrite=True)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", mode)
    n, kept = keys.count(), fresh.count()
    (spark.createDataFrame([(batch, n, kept, next_id1 + n, next_id + kept, store.rows_per_file, store.buckets)], _LOG)
     .coalesce(1).write.mode("append").parquet(f"{store.path}/log"))
    spark.catalog.refreshTable(store.table)
    return True
