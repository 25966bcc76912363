from pyspark.sql import functions as F

from passagekit.llm import language_id as g

SF = "/root/testdata/sf0.01"


def pages_of(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) > 300")
    html = F.concat(F.lit('<!DOCTYPE html><html lang="'), F.when(F.col("doc_id") % 5 == 0, "en").otherwise(F.col("lang")),
                    F.lit('"><script>var a="the of and";</script><p>'), F.substring("text", 1, 400), F.lit("</p></html>"))
    url = F.concat(F.lit("https://h"), F.col("lang"), (F.col("doc_id") % 3).cast("string"), F.lit(".example.com/x"))
    return docs.select(F.col("doc_id").alias("page_id"), url.alias("url"), html.alias("html"), "lang")


def test_held_out_accuracy(spark):
    pages = pages_of(spark).cache()
    train = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 2 = 0")
    out = g.identify(pages.withColumn("ll", F.lit(1)), train).join(pages.select("page_id", F.col("lang").alias("real")), "page_id")
    out = out.where("page_id % 2 = 1")
    assert out.where("lang = real").count() / out.count() > 0.98


def test_odd_pages(spark, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    de = docs.where("lang = 'de' AND length(text) > 500").first()["text"]
    rows = [(i, "http://de.example.org/", f"<html lang='de'>{de[:300]}</html>") for i in range(30)]
    rows += [(90, "http://de.example.org/x", ""), (91, None, None), (92, "http://new.host/", None), (None, "", "<html>"), (90, "http://de.example.org/x", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = g.identify(pages, docs).collect()
    assert len(out) == len(rows)
    assert all(r.lang is not None and 0 < r.probability <= 1 for r in out)
    assert {r.lang for r in out if r.page_id == 90} == {"de"}            # no text: the host decides
    assert g.identify(pages.where("false"), docs).collect() == []
    assert {r.lang for r in g.identify(pages, empty).collect()} == {None}
