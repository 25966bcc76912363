"""Retrieval: search hits -> sections -> lines -> re-ranked lines -> context.

Shapes at scale: hits are ``k`` rows per question, so everything keyed by
question is bounded by ``k`` (sections) or ``k_lines`` (lines). The only
many-to-many step is hits x lines on the section id; a section hit by very
many questions is salted there (its few lines are repeated per salt).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import py_strip
from ..functions.vector import sq_l2

CONTEXT_SEPARATOR = "<SS>"   # fixed value: appended after every context line
HITS_PER_TASK = 10_000           # questions of one section handled together
RETRIEVER_K = 20
CONTEXT_TOP_K = 35


def select_articles(hits: DataFrame, meta: DataFrame) -> DataFrame:
    """``(id, prompt_id, file)`` for every hit (inner equi-join on ``id``)."""
    return hits.select("prompt_id", "id").join(meta.select("id", "file"), "id").select("id", "prompt_id", "file")


def hit_files(selected: DataFrame) -> DataFrame:
    """Distinct files holding at least one hit."""
    return selected.select("file").distinct()


def load_articles(selected: DataFrame, sections: DataFrame) -> DataFrame:
    """Sections that were hit, once each: left-semi join on ``(file, id)``.

    With sections partitioned by ``file``, dynamic partition pruning opens only
    files with hits; the planner chooses how the keys travel. A semi join never
    repeats a left row and section ids are unique, so the result is distinct.
    """
    # files are numbered from 0; the predicate tells the optimizer that the keys select
    keys = selected.where(F.col("file") >= 0).select("file", "id").distinct()
    return sections.join(keys, ["file", "id"], "left_semi")


def split_lines(df: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """``(document_id, pos, text)``: every line, not stripped, empties kept."""
    return df.select(F.col(id_col).alias("document_id"),
                     F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("pos", "text"))


def sectionize(df: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Whole document as one span: ``(document_id, text, offset{start,end})``."""
    return df.select(F.col(id_col).alias("document_id"), F.col(text_col).alias("text"),
                     F.struct(F.lit(0).alias("start"), F.length(text_col).alias("end")).alias("offset"))


def rerank(hits: DataFrame, lines: DataFrame, query_vecs: DataFrame, k: int = CONTEXT_TOP_K,
           line_vec: str = "embedding", query_vec: str = "qvec") -> DataFrame:
    """Per question, the ``k`` lines of its hit sections closest to the
    question vector: ``(prompt_id, rank, document_id, pos, text, dist)``.

    Ties go to the lower ``(document_id, pos)``; questions whose sections
    have fewer than ``k`` lines get all of them.
    """
    asked = (hits.select("prompt_id", F.col("id").alias("document_id"))
             .join(query_vecs.select("prompt_id", F.col(query_vec).alias("_q")), "prompt_id"))
    # a section hit by very many questions is dealt to several tasks
    salts = F.ceil(F.col("_n") / F.lit(HITS_PER_TASK)).cast("int")
    sizes = hits.groupBy(F.col("id").alias("document_id")).agg(F.count(F.lit(1)).alias("_n"))
    asked = asked.join(sizes, "document_id").withColumn("_s", F.pmod(F.xxhash64("prompt_id"), salts).cast("int"))
    vecs = (lines.select("document_id", "pos", line_vec).join(sizes, "document_id")
            .withColumn("_s", F.explode(F.sequence(F.lit(0), salts - 1))))
    dist = F.round(sq_l2(F.col("_q"), F.col(line_vec)), 6).alias("dist")
    # neither text nor vectors go on to the exchange by question
    cand = asked.drop("_n").join(vecs.drop("_n"), ["document_id", "_s"]).select("prompt_id", "document_id", "pos", dist)
    w = Window.partitionBy("prompt_id").orderBy("dist", "document_id", "pos")
    best = cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return (best.join(lines.select("document_id", "pos", "text"), ["document_id", "pos"])
            .select("prompt_id", "rank", "document_id", "pos", "text", "dist"))


def build_context(ranked: DataFrame) -> DataFrame:
    """``(prompt_id, context)``: stripped lines in rank order, each followed
    by the separator."""
    piece = F.concat(py_strip(F.col("text")), F.lit(CONTEXT_SEPARATOR))
    return ranked.groupBy("prompt_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", piece.alias("p")))),
                                 lambda x: x["p"]), "").alias("context"))


def context_dataset(questions: DataFrame, contexts: DataFrame) -> DataFrame:
    """Final 8 columns; a question without candidate lines gets ``""``."""
    return (questions.join(contexts, "prompt_id", "left")
            .select("prompt_id", "prompt", F.coalesce("context", F.lit("")).alias("context"),
                    "A", "B", "C", "D", "E", "answer"))
