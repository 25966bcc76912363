"""Streaming ingest equals the batch rules, across two arriving batches."""

from pyspark.sql import functions as F

from passagekit.operators import corpus
from passagekit.session import scratch_path
from passagekit.sources import fixtures as fx
from passagekit.sources.readers import extract_api
from passagekit.streaming import api_section_stream, start_section_ingest

SF = "/root/testdata/sf0.001"


def test_stream_matches_batch(spark):
    arts = fx.articles(spark.read.parquet(f"{SF}/documents.parquet"))
    bodies = fx.api_responses(arts)
    src = scratch_path(spark, "t-stream-src")
    out = scratch_path(spark, "t-stream-out")
    chk = scratch_path(spark, "t-stream-chk")
    bodies.where(F.col("doc_id") < 100).write.json(f"{src}/b0")
    bodies.where(F.col("doc_id") >= 100).write.json(f"{src}/b1")
    stream = api_section_stream(spark, f"{src}/*", max_files_per_trigger=1)
    q = start_section_ingest(stream, out, chk)
    q.awaitTermination(300)
    got = spark.read.parquet(out)
    exp = corpus.clean_sections(extract_api(bodies).where(F.col("text") != ""))
    cols = ["doc_id", "sec", "text", "first_sentence"]
    assert got.count() == exp.count()
    assert got.select(*cols).exceptAll(exp.select(*cols)).count() == 0
    # re-running the query on the same checkpoint adds nothing (exactly once)
    q2 = start_section_ingest(api_section_stream(spark, f"{src}/*"), out, chk)
    q2.awaitTermination(300)
    assert spark.read.parquet(out).count() == exp.count()


def test_stream_state_dedup(spark):
    arts = fx.articles(spark.read.parquet(f"{SF}/documents.parquet"))
    bodies = fx.api_responses(arts)
    src = scratch_path(spark, "t-stream-src")
    bodies.write.json(src)
    stream = api_section_stream(spark, src, dedup="state")
    q = (stream.writeStream.format("memory").queryName("dedup_stream").outputMode("append")
         .option("checkpointLocation", scratch_path(spark, "t-chk")).trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = spark.table("dedup_stream")
    assert got.count() == got.select("h").distinct().count()
    batch = corpus.clean_sections(extract_api(bodies).where(F.col("text") != ""))
    assert got.count() == batch.select("text").distinct().count()
    plan = stream._jdf.queryExecution().analyzed().toString()
    assert "DeduplicateWithinWatermark" in plan and "EventTimeWatermark" in plan      # state does not grow for ever
