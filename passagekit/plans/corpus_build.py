"""Corpus build job: articles -> staged sections -> deduplicated corpus.

Two written stages, as the collection is built at scale:

1. ``staged``: cleaned, filtered sections with their SHA-256 (map-only from
   the articles, one pass, written once). Every later key computation reads
   only ``(doc_id, sec, h)`` thanks to Parquet column pruning, and the
   written table cuts lineage, so losing executors later never re-parses
   the articles.
2. ``sections``: survivors with final ids, partitioned by ``file``, written
   by runs of ids (:func:`write_sections_colocated`); plus
   the ``(id, file)`` metadata table. The survivor key table in between is
   written too (small), so no step recomputes the key pipeline.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import corpus
from ..session import scratch_path
from ..sources import writers

ROWS_PER_WRITER = 25_000     # rows of a file that one task writes


@dataclass
class CorpusPaths:
    staged: str
    sections: str
    metadata: str


def stage_sections(articles: DataFrame, path: str, min_len: int = corpus.MIN_SECTION_LEN,
                   mode: str = "overwrite") -> DataFrame:
    """Write parsed + filtered sections with their text hash; return the table."""
    kept = corpus.clean_sections(articles, min_len)
    kept.withColumn("h", F.sha2(F.col("text"), 256)).write.mode(mode).parquet(path)
    return articles.sparkSession.read.parquet(path)


def survivor_keys(staged: DataFrame, rows_per_file: int = corpus.ROWS_PER_FILE,
                  rows_per_range: int = 4_000_000, scratch: str | None = None) -> DataFrame:
    """``(doc_id, sec, id1, id, file)`` of the sections that survive dedup,
    computed on key rows only and written once (small; later steps read it
    twice and must not recompute the key pipeline)."""
    spark = staged.sparkSession
    scratch = scratch or scratch_path(spark, "dedup-keys")
    keys = staged.select("doc_id", "sec", "h")
    n = keys.count()  # Parquet footers only
    ids1 = corpus.dense_index_ranges(keys, ["doc_id", "sec"], "id1", f"{scratch}/ids1", rows_per_range, n)
    # first copy per text hash: partial min() on the map side, skew-proof
    first = ids1.groupBy("h").agg(F.min("id1").alias("id1"))
    ids2 = corpus.dense_index_ranges(first, ["id1"], "id", f"{scratch}/ids2", rows_per_range, n)
    (ids1.join(ids2.select("id1", "id"), "id1")
     .select("doc_id", "sec", "id1", "id", corpus.idiv("id1", rows_per_file).cast("int").alias("file"))
     .write.mode("errorifexists").parquet(f"{scratch}/survivors"))
    return spark.read.parquet(f"{scratch}/survivors")


def write_sections_colocated(staged: DataFrame, survivors: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Attach final ids to the text and write it partitioned by ``file``.

    One plan at any size: the planner picks the join, and rows are dealt by
    ``file`` and, in it, by runs of ``ROWS_PER_WRITER`` ids, so a ``file`` has few
    writers, whatever the number of files. Ids are dense, so these parts are even
    without a look at the rows (range bounds would be sampled in a first pass over
    the join and its text).
    """
    cols = ["id", "text", "first_sentence", "file", "id1", "doc_id", "sec"]
    text = staged.select("doc_id", "sec", "text", "first_sentence")
    (text.join(survivors, ["doc_id", "sec"]).select(*cols).repartition("file", corpus.idiv("id", ROWS_PER_WRITER))
     .sortWithinPartitions("file", "id").write.mode(mode).partitionBy("file").parquet(path))


def dedup_staged(staged: DataFrame, rows_per_file: int = corpus.ROWS_PER_FILE,
                 rows_per_range: int = 4_000_000, scratch: str | None = None) -> DataFrame:
    """Survivors with final ids from a staged table, lazily joined back to
    the text (see :func:`write_sections_colocated` for the written form)."""
    survivors = survivor_keys(staged, rows_per_file, rows_per_range, scratch)
    return (staged.select("doc_id", "sec", "text", "first_sentence").join(survivors, ["doc_id", "sec"])
            .select("id", "text", "first_sentence", "file", "id1", "doc_id", "sec"))


def ids_staged(staged: DataFrame, rows_per_file: int = corpus.ROWS_PER_FILE,
               rows_per_range: int = 4_000_000, scratch: str | None = None) -> DataFrame:
    """Sections with their ids before dedup and the file each goes to
    (numbered on key rows, then one join back to the text)."""
    spark = staged.sparkSession
    scratch = scratch or scratch_path(spark, "ids-keys")
    ids1 = corpus.dense_index_ranges(staged.select("doc_id", "sec"), ["doc_id", "sec"], "id",
                                     f"{scratch}/ids1", rows_per_range)
    return (staged.select("doc_id", "sec", "text", "first_sentence").join(ids1, ["doc_id", "sec"])
            .withColumn("file", corpus.idiv("id", rows_per_file).cast("int")))


def stats_staged(staged: DataFrame, rows_per_file: int = corpus.ROWS_PER_FILE,
                 rows_per_range: int = 4_000_000, scratch: str | None = None) -> DataFrame:
    """Per-file and total ``(file, is_total, original, duplicated, final)``
    from a staged table, on key rows only."""
    spark = staged.sparkSession
    scratch = scratch or scratch_path(spark, "dedup-stats")
    ids1 = corpus.dense_index_ranges(staged.select("doc_id", "sec", "h"), ["doc_id", "sec"], "id1",
                                     f"{scratch}/ids1", rows_per_range)
    file = corpus.idiv("id1", rows_per_file).cast("int").alias("file")
    orig = ids1.select(file)
    surv = ids1.groupBy("h").agg(F.min("id1").alias("id1")).select(file)
    per_file = (orig.groupBy("file").agg(F.count(F.lit(1)).alias("original"))
                .join(surv.groupBy("file").agg(F.count(F.lit(1)).alias("final")), "file", "left")
                .fillna(0, ["final"]))
    agg = per_file.rollup("file").agg(F.sum("original").alias("original"), F.sum("final").alias("final"),
                                      F.grouping_id().alias("_g"))
    return agg.select("file", (F.col("_g") == 1).alias("is_total"), "original",
                      (F.col("original") - F.col("final")).alias("duplicated"), "final")


def build_corpus(articles: DataFrame, root: str | None = None, rows_per_file: int = corpus.ROWS_PER_FILE,
                 mode: str = "overwrite") -> CorpusPaths:
    spark: SparkSession = articles.sparkSession
    root = root or scratch_path(spark, "corpus")
    paths = CorpusPaths(f"{root}/staged", f"{root}/sections", f"{root}/metadata")
    staged = stage_sections(articles, paths.staged, mode=mode)
    survivors = survivor_keys(staged, rows_per_file, scratch=f"{root}/keys")
    write_sections_colocated(staged, survivors, paths.sections, mode=mode)
    sections = spark.read.parquet(paths.sections)
    writers.write_metadata(corpus.metadata(sections), paths.metadata, mode=mode)
    return paths
