"""Retrieval job: questions -> top-k sections -> top-k lines -> contexts.

Inputs are the corpus tables (sections partitioned by ``file``, metadata)
and the vector table. The search result is written once (it is small:
k rows per question) so the later size checks and joins reuse it instead of
re-running the search; everything after it is lazy.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..functions.text import query_text
from ..operators import encode, knn, retrieve
from ..session import scratch_path
from ..sources import writers


@dataclass
class Retrieval:
    query_vectors: DataFrame
    hits: DataFrame
    selected: DataFrame
    loaded: DataFrame
    lines: DataFrame
    ranked: DataFrame
    contexts: DataFrame


def question_vectors(questions: DataFrame, encoder) -> DataFrame:
    q = questions.select("prompt_id", query_text(prefix=encoder.query_prefix).alias("_qt"))
    return encode.encode(q, encoder, "_qt", "embedding").select("prompt_id", "embedding")


def _written(df: DataFrame) -> DataFrame:
    path = scratch_path(df.sparkSession, "question-vectors")
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path)


def retrieve_contexts(questions: DataFrame, sections: DataFrame, metadata: DataFrame, vectors: DataFrame,
                      encoder, k: int = retrieve.RETRIEVER_K, k_lines: int = retrieve.CONTEXT_TOP_K,
                      line_encoder=None, hits_path: str | None = None) -> Retrieval:
    """All stages of retrieval; ``line_encoder`` re-ranks lines (defaults to
    ``encoder``), questions are encoded once per encoder."""
    spark = questions.sparkSession
    qv = _written(question_vectors(questions, encoder))      # each encoder runs once per question
    hits_path = hits_path or scratch_path(spark, "hits")
    knn.knn(qv, vectors.select("id", "embedding"), k).write.mode("errorifexists").parquet(hits_path)
    hits = spark.read.parquet(hits_path)
    selected = retrieve.select_articles(hits, metadata)
    loaded = retrieve.load_articles(selected, sections.select("id", "text", "first_sentence", "file"))
    lines = retrieve.split_lines(loaded)
    le = line_encoder or encoder
    lv = encode.encode(lines, le, "text", "embedding", prefix=le.passage_prefix)
    lqv = qv if le is encoder else _written(question_vectors(questions, le))
    ranked = retrieve.rerank(hits, lv, lqv.withColumnRenamed("embedding", "qvec"), k_lines)
    contexts = retrieve.context_dataset(questions, retrieve.build_context(ranked))
    return Retrieval(qv, hits, selected, loaded, lines, ranked, contexts)


def write_contexts(r: Retrieval, path: str, mode: str = "ignore") -> None:
    """Contextual-question CSV; ``ignore`` skips a run whose output exists."""
    writers.write_context_csv(r.contexts, path, mode=mode)
