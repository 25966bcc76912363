"""Streaming ingest: API responses arriving as files -> staged sections.

The collector delivers responses in batches; each new file is picked up by a
file-source stream, parsed with the same map-only section rules as the
batch job and appended to the staged table through the exactly-once Parquet
file sink. The batch corpus job (exact dedup and dense ids over the whole
staged table) then runs on the result, so streaming needs no unbounded
state.

Optional ``dedup="state"`` drops later copies of a text already seen by the
stream (state keyed by the SHA-256, first arrival wins; within one
micro-batch the tie between copies is not ordered). State is bounded: a text is
remembered for ``dedup_within`` after the arrival (file time) of its first copy;
later copies are for the batch job. Use a RocksDB state store for large corpora.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import FIRST_SENTENCE_CHARS, article_section_texts
from ..operators import corpus
from ..sources.readers import extract_api

RESPONSE_SCHEMA = "doc_id long, body string"


def api_section_stream(spark: SparkSession, source_dir: str, fmt: str = "json",
                       schema: str = RESPONSE_SCHEMA, max_files_per_trigger: int | None = None,
                       dedup: str | None = None, dedup_within: str = "7 days") -> DataFrame:
    """Streaming DataFrame of staged sections ``(doc_id, sec, text,
    first_sentence, h)`` from response files in ``source_dir``."""
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    responses = reader.load(source_dir).withColumn("_arrived", F.col("_metadata.file_modification_time"))
    raw = extract_api(responses).where(F.col("text") != "")
    if dedup != "state":
        return corpus.clean_sections(raw).withColumn("h", F.sha2(F.col("text"), 256))
    sections = raw.select("doc_id", "_arrived", F.posexplode(article_section_texts(F.col("text"))).alias("sec", "text"),
                          F.substring("text", 1, FIRST_SENTENCE_CHARS).alias("first_sentence"))
    staged = corpus.filter_sections(sections).withColumn("h", F.sha2(F.col("text"), 256))
    return staged.withWatermark("_arrived", dedup_within).dropDuplicatesWithinWatermark(["h"]).drop("_arrived")


def start_section_ingest(stream: DataFrame, out_dir: str, checkpoint_dir: str,
                         available_now: bool = True, processing_time: str | None = None) -> StreamingQuery:
    """Append the stream to the staged Parquet table (exactly-once sink)."""
    w = (stream.writeStream.format("parquet").outputMode("append")
         .option("path", out_dir).option("checkpointLocation", checkpoint_dir))
    if available_now:
        w = w.trigger(availableNow=True)
    elif processing_time:
        w = w.trigger(processingTime=processing_time)
    return w.start()
