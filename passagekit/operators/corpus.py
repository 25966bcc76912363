"""Corpus build: articles -> cleaned sections -> exact dedup -> dense ids.

Plan shape at scale
-------------------
* Article parsing is a single projection per article row (no shuffle): the
  line rules run as higher-order functions over the article's lines.
* Dedup and numbering run on small key rows ``(doc_id, sec, h)``; the hash
  group-by aggregates partially on the map side, so a group of copies holding
  a third of all rows costs one row per task before the exchange.
* Dense ids (``dense_index_ranges``): key rows range-partitioned on the
  order (balanced by Spark's sampled bounds), sorted per range, range and
  position written once; id = range offset (prefix sum over one row per
  range) + position. One exchange, no global single-task window.
  ``dense_index`` is the lighter in-memory variant for dense key ranges.
* The section text is shuffled once, to attach the final ids and lay out
  the files (``plans.corpus_build.write_sections_colocated``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arith import idiv
from ..functions.text import (
    DISAMBIGUATION_PHRASE, FIRST_SENTENCE_CHARS, MIN_SECTION_LEN,
    article_section_texts, is_references_line, line_class, py_strip,
)

ROWS_PER_FILE = 250_000     # sections per output file
BUCKET_DOCS = 1 << 16       # documents per numbering bucket



# ---------------------------------------------------------------------------
# Lines and sections
# ---------------------------------------------------------------------------

def line_kind(t: Column, c: Column) -> Column:
    """Name of the first rule that decides a stripped line's fate."""
    n = F.length(t)
    is_head = t.startswith("=") & t.endswith("=")
    ok_len = (n >= 7) & (n < 100)
    return (F.when(n == 0, "empty")
            .when(c["is_ref"], "references")
            .when(c["brk"], "heading_break")
            .when(c["app"], "heading_append")
            .when(is_head & ~ok_len, "heading_dropped")
            .when(is_head, "heading_ignored")
            .when(n < 50, "short")
            .when(t.startswith("{") & t.endswith("}"), "latex")
            .otherwise("text"))


def section_lines(articles: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per raw line: ``(doc_id, pos, line, kind, content, stopped)``.

    ``content`` is what the line adds to its section (pieces joined by
    newline, ``""`` if nothing); ``stopped`` marks lines at or after the
    first references line, which add nothing.
    """
    lines = F.split(F.col(text_col), "\n", -1)
    refs = F.transform(lines, lambda l: is_references_line(py_strip(l)))
    first_ref = F.array_position(refs, True) - 1  # -1 if none
    df = articles.select(F.col(id_col).alias("doc_id"), first_ref.alias("_fr"),
                         F.posexplode(lines).alias("pos", "line"))
    t = py_strip(F.col("line"))
    df = df.withColumn("_t", t).withColumn("_c", line_class(F.col("_t")))
    stopped = (F.col("_fr") >= 0) & (F.col("pos") >= F.col("_fr"))
    return df.select(
        "doc_id", "pos", F.col("_t").alias("line"),
        line_kind(F.col("_t"), F.col("_c")).alias("kind"),
        F.when(stopped, F.lit("")).otherwise(F.array_join(F.col("_c")["pieces"], "\n")).alias("content"),
        stopped.alias("stopped"),
    )


def article_sections(articles: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every section of every article: ``(doc_id, sec, text, first_sentence)``.

    Section 0 is the lead (possibly empty); the last section is always kept.
    ``first_sentence`` is the article's first 100 characters.
    """
    return articles.select(
        F.col(id_col).alias("doc_id"),
        F.posexplode(article_section_texts(F.col(text_col))).alias("sec", "text"),
        F.substring(F.col(text_col), 1, FIRST_SENTENCE_CHARS).alias("first_sentence"),
    )


def keep_section(text: Column, min_len: int = MIN_SECTION_LEN) -> Column:
    return (F.length(text) >= min_len) & ~F.lower(F.substring(text, 1, 100)).contains(DISAMBIGUATION_PHRASE)


def filter_sections(df: DataFrame, min_len: int = MIN_SECTION_LEN) -> DataFrame:
    """Drop sections shorter than ``min_len`` or that look like disambiguation pages."""
    return df.where(keep_section(F.col("text"), min_len))


def clean_sections(articles: DataFrame, min_len: int = MIN_SECTION_LEN) -> DataFrame:
    """Article parsing + section filter, still map-only."""
    return filter_sections(article_sections(articles), min_len)


# ---------------------------------------------------------------------------
# Dense ids
# ---------------------------------------------------------------------------

def dense_index(df: DataFrame, order_cols: list[str], bucket: Column, id_col: str = "id") -> DataFrame:
    """Add ``id_col`` = 0-based position of each row in ``order_cols`` order.

    ``bucket`` must be monotone in the order (a key range such as
    ``doc_id div B``) so that bucket order + in-bucket order is the global
    order. The per-bucket count table has one row per bucket; its prefix sum
    is a window over that tiny table, and AQE broadcasts it at run time.
    """
    b = df.withColumn("_b", bucket)
    counts = b.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inb = Window.partitionBy("_b").orderBy(*order_cols)
    return (b.join(offsets, "_b")
            .withColumn(id_col, F.col("_off") + F.row_number().over(inb) - 1)
            .drop("_b", "_off"))


MIN_RANGES = 8                     # ranges at any size: numbering is never one task
MAX_BROADCAST_RANGES = 1_000_000   # offsets table rows broadcast at most (16 bytes a row)


def dense_index_ranges(df: DataFrame, order_cols: list[str], id_col: str, path: str,
                       rows_per_range: int = 4_000_000, n_rows: int | None = None) -> DataFrame:
    """Dense 0-based positions in ``order_cols`` order, balanced by data.

    Rows are range-partitioned on the order (bounds from Spark's sample, so
    every range holds about ``rows_per_range`` rows whatever the key
    distribution) and sorted inside each range; a row's range and position
    are then read off ``monotonically_increasing_id`` (partition index in
    the high bits, position in the low 33). Writing them once fixes the
    assignment, so recomputation after an executor loss cannot move a row.
    The id is the range's offset (prefix sum over one count row per range,
    broadcast: its size is the known number of ranges) plus the position:
    one exchange in all, no window over the rows. ``order_cols`` must be
    unique. Meant for small key rows (the text stays behind); ``n_rows``
    (an upper bound of the row count) sizes the ranges and saves a count.
    """
    spark = df.sparkSession
    n = df.count() if n_rows is None else n_rows
    parts = max(MIN_RANGES, -(-n // rows_per_range))
    mid = F.monotonically_increasing_id()
    (df.repartitionByRange(parts, *order_cols).sortWithinPartitions(*order_cols)
     .withColumn("_m", mid)
     .withColumn("_r", F.shiftright(F.col("_m"), 33).cast("int"))
     .withColumn("_p", F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)))
     .drop("_m").write.mode("errorifexists").parquet(path))
    keyed = spark.read.parquet(path)
    counts = keyed.groupBy("_r").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_r", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    if parts <= MAX_BROADCAST_RANGES:
        offsets = F.broadcast(offsets)
    return (keyed.join(offsets, "_r")
            .withColumn(id_col, F.col("_off") + F.col("_p"))
            .drop("_r", "_p", "_off"))


def metadata(sections_with_ids: DataFrame) -> DataFrame:
    """``(id, file)`` lookup of where each section lives."""
    return sections_with_ids.select(F.col("id").cast("long"), F.col("file").cast("int"))


def first_sentence_rows(articles: DataFrame) -> DataFrame:
    """``(doc_id, first_sentence)`` per article (its first 100 characters)."""
    return articles.select("doc_id", F.substring("text", 1, FIRST_SENTENCE_CHARS).alias("first_sentence"))
