"""Readers: question CSV, section/metadata/vector Parquet, raw texts, API JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .csv_ranges import read_csv

QUESTION_COLUMNS = ["prompt", "A", "B", "C", "D", "E", "answer"]
# Strings pandas' CSV reader turns into missing values by default.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
             "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

API_SCHEMA = T.StructType([T.StructField("query", T.StructType([
    T.StructField("pages", T.MapType(T.StringType(), T.StructType([
        T.StructField("extract", T.StringType())])))]))])


def read_questions_csv(spark: SparkSession, path: str, unlabeled: bool = False,
                       columns: list[str] | None = None) -> DataFrame:
    """Question CSV (header, quoted multi-line fields) with ``prompt_id`` =
    row position (files in name order, rows in file order).

    Files are read in byte ranges (:mod:`.csv_ranges`). Every column is read as
    string (no inference); the NA tokens become null; an ``id`` column is dropped;
    ``unlabeled`` data gets ``answer = 'A'``.
    """
    raw = read_csv(spark, path, "prompt_id")
    cols = [c for c in raw.columns if c not in ("id", "prompt_id")]
    df = raw.select("prompt_id", *[F.when(F.col(c).isin(NA_TOKENS), F.lit(None)).otherwise(F.col(c)).alias(c) for c in cols])
    if unlabeled:
        df = df.withColumn("answer", F.lit("A"))
    keep = ["prompt_id"] + [c for c in (columns or QUESTION_COLUMNS) if c in df.columns]
    return df.select(*keep)


def read_sections(spark: SparkSession, path: str) -> DataFrame:
    """Section table (``id, text, first_sentence``; partition column ``file``).

    Only the ``file=`` directories are read: metadata and index files may lie
    in the same directory."""
    return spark.read.option("basePath", path).parquet(f"{path}/file=*")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """``(id long, file int)``; only the two columns are read."""
    return spark.read.parquet(path).select(F.col("id").cast("long"), F.col("file").cast("int"))


def read_raw_texts(spark: SparkSession, path: str) -> DataFrame:
    """Raw article batches ``(doc_id, text)``; empty texts (failed fetches) skipped."""
    return spark.read.parquet(path).where(F.col("text") != "")


def extract_api(df: DataFrame, body: str = "body", out: str = "text") -> DataFrame:
    """Article text from an API JSON body: the first page's ``extract``;
    malformed JSON, a missing path or a missing extract all give ``""``."""
    parsed = F.from_json(F.col(body), API_SCHEMA, {"mode": "PERMISSIVE"})
    first = F.try_element_at(F.map_values(parsed["query"]["pages"]), F.lit(1))
    return df.withColumn(out, F.coalesce(first["extract"], F.lit(""))).drop(body)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Vector table ``(id, embedding[, shard, local_id])``."""
    return spark.read.parquet(path)
