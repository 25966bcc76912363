"""Registered queries: one per operator family of the survey's inventory.

Each entry takes ``(spark, sf_dir)`` and returns a DataFrame over the whole
driver tables (or data Spark derives from them). Column names equal those of
the matching SQL in :mod:`passagekit.plans.oracle`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.arith import idiv
from ..functions.text import BGE_MODELS, passage_text, query_text, section_headers
from ..functions.vector import l2_normalize
from ..operators import cells, choices, corpus, encode, evaluate, knn, quantized, retrieve
from ..operators.bag_model import bag_model
from ..operators.tokens import RankTokenizer
from ..session import scratch_path
from ..sources import fixtures as fx
from ..sources import lookup, readers, writers
from . import corpus_build, incremental, index_build, retrieval
from .context import CONTEXT_TOP_K, ENCODER_DIM, QUERY_MODEL, RETRIEVER_K, ROWS_PER_FILE, Inputs

DROP_POSITIONS = [0, 7, 13, 100_000]     # three that exist and one beyond our tables
SHUFFLE_SEED = 0
MAX_TOKENS = 64
SHARDS = 16
DEV_ROWS_PER_FILE = 100
DEV_ROWS = 100
HEAD_ROWS = 50
DEV_BATCHES, BATCH_ROWS = 3, 256     # small stand-in for batches of 4,096
LINE_DIM = 128
SUBWORD_TOKENS = 256
MIN_RECALL = 0.9
BATCHES, STORE_BUCKETS, LOOKUP_BUCKETS = 3, 16, 16
BGE_MODEL = sorted(BGE_MODELS)[0]


def _i(spark, sf_dir) -> Inputs:
    return Inputs(spark, sf_dir)


# ---- A. ingest ------------------------------------------------------------------

def q_extract_api(spark, d):
    return readers.extract_api(fx.api_responses(_i(spark, d).t("documents"))).select("doc_id", "text")


def q_raw_scan(spark, d):
    path = scratch_path(spark, "raw")
    q_extract_api(spark, d).write.mode("errorifexists").parquet(path)
    return readers.read_raw_texts(spark, path).select("doc_id", "text")


# ---- B. corpus ------------------------------------------------------------------

def q_section_lines(spark, d):
    return corpus.section_lines(_i(spark, d).articles)


def q_article_sections(spark, d):
    return _i(spark, d).sections_all


def q_first_sentence(spark, d):
    return corpus.first_sentence_rows(_i(spark, d).articles)


def q_sections_filtered(spark, d):
    return _i(spark, d).kept


def q_sections_ids(spark, d):
    return corpus_build.ids_staged(_i(spark, d).staged, ROWS_PER_FILE).select(
        "id", "doc_id", "sec", "text", "first_sentence", "file")


def q_dedup_exact(spark, d):
    return _i(spark, d).corpus.select("id1", "doc_id", "sec", "text")


def q_dedup_stats(spark, d):
    return corpus_build.stats_staged(_i(spark, d).staged, ROWS_PER_FILE)


def q_reindex_ids(spark, d):
    return _i(spark, d).corpus.select("id", "id1", "file", "text", "first_sentence")


def q_dedup_incremental(spark, d):
    """The corpus taken in three batches of documents."""
    a, path = _i(spark, d).articles, scratch_path(spark, "store")
    store = incremental.Store(spark, path, ROWS_PER_FILE, STORE_BUCKETS)
    third = idiv(a.select(F.max("doc_id")).scalar() + BATCHES, F.lit(BATCHES))
    for b in range(BATCHES):
        incremental.add_batch(store, a.where(idiv("doc_id", third) == b), b)
    return store.sections().select("id", "id1", "file", "text", "first_sentence")


def q_sections_sharded(spark, d):
    path = scratch_path(spark, "sections")
    writers.write_sections(_i(spark, d).corpus, path, mode="errorifexists")
    return readers.read_sections(spark, path).select("id", "text", "first_sentence", "file")


def q_metadata_build(spark, d):
    path = scratch_path(spark, "metadata")
    writers.write_metadata(_i(spark, d).meta, path, mode="errorifexists")
    return readers.read_metadata(spark, path)


def q_corpus_stats(spark, d):
    i = _i(spark, d)
    s = i.corpus.agg(F.count(F.lit(1)).alias("n_sections"))
    v = i.embeddings.agg(F.count(F.lit(1)).alias("n_vectors"), F.max(F.size("embedding")).alias("dim"))
    return s.select("n_sections", v.select("n_vectors").scalar().alias("n_vectors"),
                    v.select("dim").scalar().alias("dim"))


def q_dev_slice(spark, d):
    w = Window.partitionBy("file").orderBy("id")
    return (_i(spark, d).corpus.withColumn("rn", F.row_number().over(w))
            .where(F.col("rn") <= DEV_ROWS_PER_FILE).select("id", "file", "text"))


# ---- C. encode / vectors ------------------------------------------------------------

def q_encode_hash(spark, d):
    i = _i(spark, d)
    return encode.encode_sparse(i.corpus, i.encoder, "id")


def q_encode_norm(spark, d):
    e = _i(spark, d).embeddings
    n = e.select("vec_id", F.posexplode(l2_normalize(F.col("embedding"))).alias("pos", "x"))
    return n.select(F.col("vec_id").alias("id"), "pos", "x")


def q_query_text(spark, d):
    return _i(spark, d).questions.select("prompt_id", query_text(QUERY_MODEL).alias("query_text"))


def q_passage_text(spark, d):
    c = _i(spark, d).corpus.withColumn("headers", section_headers(F.col("text"), F.col("sec")))
    return c.select("id", passage_text(QUERY_MODEL, add_tags=True, add_first_sentence=True).alias("passage"))


def q_knn_flat(spark, d):
    e = _i(spark, d).embeddings
    return knn.knn(fx.vector_queries(e), fx.vectors(e), RETRIEVER_K)


def q_knn_sharded(spark, d):
    e = _i(spark, d).embeddings
    return knn.knn_sharded(fx.vector_queries(e), knn.shard_vectors(fx.vectors(e), SHARDS), RETRIEVER_K)


def _pruned(spark, d) -> cells.PrunedSearch:
    e = _i(spark, d).embeddings
    index = cells.build_cell_index(fx.vectors(e), scratch_path(spark, "cells"))
    return cells.search_cells(fx.vector_queries(e), index, RETRIEVER_K)


def q_knn_pruned(spark, d):
    """The flat search's answer from an index of cells."""
    return _pruned(spark, d).hits


def q_knn_pruned_cells(spark, d):
    """What each query of the pruned search read."""
    return cells.pruned_report(_pruned(spark, d))


def q_knn_recall(spark, d):
    """The approximate search against the exact one, over all rows."""
    e = _i(spark, d).embeddings
    index = cells.build_bucket_index(fx.vectors(e), scratch_path(spark, "buckets"))
    found = cells.search_buckets(fx.vector_queries(e), index, RETRIEVER_K)
    r = cells.recall_of(found, knn.knn(fx.vector_queries(e), fx.vectors(e), RETRIEVER_K))
    return r.select("queries", "wanted", (F.col("recall") >= MIN_RECALL).alias("enough"))


def q_knn_bytes(spark, d):
    """The flat search's answer from vectors of one byte per component."""
    e = _i(spark, d).embeddings
    index = quantized.build_byte_index(fx.vectors(e), scratch_path(spark, "bytes"), LOOKUP_BUCKETS)
    return quantized.search_bytes(fx.vector_queries(e), index, RETRIEVER_K).hits


def q_articles_by_id(spark, d):
    """Hit sections, with their file, from tables laid out by id."""
    i = _i(spark, d)
    sections = lookup.write_lookup(i.corpus.select("id", "text", "first_sentence"), scratch_path(spark, "by-id"), "id", LOOKUP_BUCKETS)
    meta = lookup.write_lookup(i.meta, scratch_path(spark, "meta-by-id"), "id", LOOKUP_BUCKETS)
    return lookup.look_up(sections.join(meta, "id"), i.hits)


def q_vector_shards(spark, d):
    e = _i(spark, d).embeddings
    path = scratch_path(spark, "vectors")
    writers.write_vectors(knn.shard_vectors(fx.vectors(e), SHARDS), path, mode="errorifexists")
    return readers.read_vectors(spark, path).select("id", "shard", "local_id")


def q_vectors_scan(spark, d):
    """Vector table written (partitioned by shard) and every vector recovered
    from it, in long form ``(id, pos, x)``."""
    e = _i(spark, d).embeddings
    path = scratch_path(spark, "vectors")
    writers.write_vectors(knn.shard_vectors(fx.vectors(e), SHARDS), path, mode="errorifexists")
    v = readers.read_vectors(spark, path)
    return v.select("id", F.posexplode("embedding").alias("pos", "x"))


def q_shard_offsets(spark, d):
    e = _i(spark, d).embeddings
    return knn.shard_offsets(knn.shard_vectors(fx.vectors(e), SHARDS))


# ---- D. retrieval -------------------------------------------------------------------

def q_select_articles(spark, d):
    return _i(spark, d).selected


def q_hit_files(spark, d):
    return retrieve.hit_files(_i(spark, d).selected)


def q_load_articles(spark, d):
    return _i(spark, d).loaded.select("id", "text", "first_sentence", "file")


def q_split_lines(spark, d):
    return _i(spark, d).lines


def q_sectionize(spark, d):
    s = retrieve.sectionize(_i(spark, d).loaded)
    return s.select("document_id", "text", F.col("offset.start").alias("start"), F.col("offset.end").alias("end"))


def q_rerank_lines(spark, d):
    return _i(spark, d).ranked.select("prompt_id", "rank", "document_id", "pos", "dist")


def q_context_dataset(spark, d):
    return _i(spark, d).contexts


def q_context_csv(spark, d):
    """Contextual questions through the CSV sink and back (quotes, commas,
    newlines and ``<SS>`` inside fields)."""
    path = scratch_path(spark, "contexts_csv")
    writers.write_context_csv(_i(spark, d).contexts.orderBy("prompt_id"), path, mode="errorifexists")
    return readers.read_questions_csv(spark, path, columns=writers.CONTEXT_COLUMNS)


# ---- E. multiple choice ------------------------------------------------------------------

def q_questions_load(spark, d):
    q = _i(spark, d).questions
    path = scratch_path(spark, "questions_csv")
    out = q.withColumn("id", F.col("prompt_id")).orderBy("prompt_id")
    writers.write_csv(out, path, ["id", "prompt", "A", "B", "C", "D", "E", "answer"], mode="errorifexists")
    return readers.read_questions_csv(spark, path)


def q_fill_options(spark, d):
    return choices.fill_options(_i(spark, d).questions).select("prompt_id", "A", "B", "C", "D", "E")


def q_drop_rows(spark, d):
    return choices.drop_rows(_i(spark, d).questions, DROP_POSITIONS).select("prompt_id", "prompt")


def q_shuffle_rows(spark, d):
    return choices.shuffle_rows(_i(spark, d).questions, SHUFFLE_SEED).select("prompt_id", "shuffle_key", "position")


def q_union_train(spark, d):
    q = _i(spark, d).questions.select("prompt_id", "prompt", "answer")
    return choices.union_train(q.withColumn("source", F.lit("train")), q.withColumn("source", F.lit("valid")))


def q_prepare_split(spark, d):
    """Drop, concatenate, shuffle, head and fill, composed."""
    q = _i(spark, d).questions
    return choices.prepare_split(q, q, DROP_POSITIONS, SHUFFLE_SEED, DEV_ROWS).select(
        "row_id", "prompt_id", "position", "prompt", "A", "B", "C", "D", "E", "answer")


def q_questions_unlabeled(spark, d):
    """Questions without answers through the CSV source: answer is ``A``."""
    path = scratch_path(spark, "unlabeled_csv")
    q = _i(spark, d).questions.orderBy("prompt_id")
    writers.write_csv(q, path, ["prompt", "A", "B", "C", "D", "E"], mode="errorifexists")
    return readers.read_questions_csv(spark, path, unlabeled=True)


def q_sections_scan(spark, d):
    """Section directory that also holds the metadata table."""
    i, path = _i(spark, d), scratch_path(spark, "sections")
    writers.write_sections(i.corpus, path, mode="errorifexists")
    writers.write_metadata(i.meta, f"{path}/metadata.parquet", mode="errorifexists")
    return readers.read_sections(spark, path).select("id", "text", "first_sentence", "file")


def q_articles_sorted(spark, d):
    """Hits in ``(file, id)`` order, with their position."""
    return corpus.dense_index_ranges(_i(spark, d).selected, ["file", "id", "prompt_id"], "position", scratch_path(spark, "sorted"))


def q_sectionize_sorted(spark, d):
    """Spans in ``(document_id, offset)`` order, with their position."""
    s = retrieve.sectionize(_i(spark, d).loaded).select(
        "document_id", F.col("offset.start").alias("start"), F.col("offset.end").alias("end"))
    return corpus.dense_index_ranges(s, ["document_id", "start", "end"], "position", scratch_path(spark, "sorted"))


def q_query_text_bge(spark, d):
    return _i(spark, d).questions.select("prompt_id", query_text(BGE_MODEL).alias("query_text"))


def q_mc_pairs_shuffled(spark, d):
    """The other options in a seeded order (the default of training data)."""
    return choices.mc_pairs(_ctx_filled(spark, d), with_answers=True, shuffle_seed=SHUFFLE_SEED)


def q_knn_nan(spark, d):
    """Every seventh vector, queries among them, has a NaN component: such
    vectors rank last, no finite neighbour is lost, and a NaN query gets the
    first ids with no distance."""
    e = _i(spark, d).embeddings
    bad = F.transform("embedding", lambda x, i: F.when((F.col("vec_id") % 7 == 0) & (i == 3), F.lit("NaN").cast("float")).otherwise(x))
    e = e.withColumn("embedding", bad)
    return knn.knn(fx.vector_queries(e), fx.vectors(e), RETRIEVER_K).withColumn("dist", F.when(~F.isnan("dist"), F.col("dist")))


def q_sink_modes(spark, d):
    """Overwrite replaces an output, ignore leaves a finished one alone."""
    path = scratch_path(spark, "modes")
    letters = evaluate.pred_letters(_i(spark, d).predictions)
    letters.where("id < 10").write.mode("overwrite").parquet(path)
    letters.write.mode("overwrite").parquet(path)
    letters.where("id < 10").write.mode("ignore").parquet(path)
    return spark.read.parquet(path)


def q_sink_outcomes(spark, d):
    """What each save mode does to a finished output."""
    path = scratch_path(spark, "modes")
    letters = evaluate.pred_letters(_i(spark, d).predictions)
    letters.where("id < 10").write.mode("errorifexists").parquet(path)
    letters.write.mode("overwrite").parquet(path)
    out = [("overwrite", "replaced")]
    letters.where("id < 10").write.mode("ignore").parquet(path)
    out.append(("ignore", "kept"))
    try:
        letters.where("id < 10").write.mode("errorifexists").parquet(path)
        out.append(("errorifexists", "written"))
    except AnalysisException:
        out.append(("errorifexists", "refused"))
    outcomes = spark.createDataFrame(out, "mode string, outcome string")
    return outcomes.withColumn("n", spark.read.parquet(path).agg(F.count(F.lit(1))).scalar())


def q_output_named(spark, d):
    """Contextual questions written to the name that the run's parameters give,
    and read back from it."""
    name = writers.output_name(scratch_path(spark, "out"), "idx/sections_v1.index", "benchmark.csv", QUERY_MODEL, RETRIEVER_K, "v1", True)
    writers.write_context_csv(_i(spark, d).contexts.orderBy("prompt_id"), name)
    back = readers.read_questions_csv(spark, name, columns=writers.CONTEXT_COLUMNS)
    return back.select("prompt_id", "prompt", "context", F.lit(name.rsplit("/", 1)[-1]).alias("output"))


def q_dev_slice_500(spark, d):
    """The quick-run slice at its own size: 500 rows of each file of 1,000."""
    c = _i(spark, d).corpus.withColumn("file", idiv("id1", 1000).cast("int"))
    w = Window.partitionBy("file").orderBy("id")
    return c.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= 500).select("id", "file", "text")


def q_prepare_split_head(spark, d):
    """The preparation with a head that cuts."""
    q = _i(spark, d).questions
    return choices.prepare_split(q, q, DROP_POSITIONS, SHUFFLE_SEED, HEAD_ROWS).select(
        "row_id", "prompt_id", "position", "prompt", "A", "B", "C", "D", "E", "answer")


def q_encode_batches(spark, d):
    """The quick run of the encoder: it stops after three batches of sections."""
    i = _i(spark, d)
    return encode.encode_sparse(i.corpus.where(F.col("id") < DEV_BATCHES * BATCH_ROWS), i.encoder, "id")


def q_context_two_encoders(spark, d):
    """Retrieval with a model for the index and another one for the lines, each
    with its own prefixes."""
    i = _i(spark, d)
    index = bag_model(BGE_MODEL, ENCODER_DIM)
    lines = bag_model(QUERY_MODEL, LINE_DIM)
    vectors = index_build.build_index(i.corpus, index, scratch_path(spark, "index"))
    return retrieval.retrieve_contexts(i.questions, i.corpus, i.meta, vectors, index, RETRIEVER_K, CONTEXT_TOP_K, line_encoder=lines).contexts


def _subwords():
    import public_tokenizers
    return RankTokenizer(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def q_truncate_pairs_subword(spark, d):
    """Pairs cut to a budget of sub-word tokens."""
    return choices.truncate_pairs(choices.mc_pairs(_ctx_filled(spark, d), with_answers=True), SUBWORD_TOKENS, _subwords())


def q_token_lengths_subword(spark, d):
    return choices.token_lengths(_i(spark, d).t("documents"), "lang", tokenizer=_subwords())


def _ctx_filled(spark, d) -> DataFrame:
    return choices.fill_options(_i(spark, d).contexts)


def q_mc_pairs(spark, d):
    return choices.mc_pairs(_ctx_filled(spark, d))


def q_mc_pairs_answers(spark, d):
    return choices.mc_pairs(_ctx_filled(spark, d), with_answers=True)


def q_truncate_pairs(spark, d):
    return choices.truncate_pairs(choices.mc_pairs(_ctx_filled(spark, d), with_answers=True), MAX_TOKENS)


def q_token_lengths(spark, d):
    return choices.token_lengths(_i(spark, d).t("documents"), "lang")


def q_eval_map3(spark, d):
    return evaluate.map_at_k(_i(spark, d).predictions, 3)


def q_pred_letters(spark, d):
    return evaluate.pred_letters(_i(spark, d).predictions)


def q_pred_csv(spark, d):
    """Prediction letters through the CSV sink (``pred,label``) and back;
    ``prompt_id`` is the row position, rows written in id order."""
    path = scratch_path(spark, "preds_csv")
    writers.write_predictions_csv(evaluate.pred_letters(_i(spark, d).predictions).orderBy("id"), path,
                                  mode="errorifexists")
    return readers.read_questions_csv(spark, path, columns=["pred", "label"])


def q_dev_prompt(spark, d):
    """Equality filter on one prompt, first match only (the quick-run slice)."""
    q = _i(spark, d).questions
    target = q.select(F.min("prompt")).scalar()
    return q.where(F.col("prompt") == target).orderBy("prompt_id").limit(1).select("prompt_id", "prompt", "answer")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "extract_api": q_extract_api,
    "raw_scan": q_raw_scan,
    "section_lines": q_section_lines,
    "article_sections": q_article_sections,
    "first_sentence": q_first_sentence,
    "sections_filtered": q_sections_filtered,
    "sections_ids": q_sections_ids,
    "dedup_exact": q_dedup_exact,
    "dedup_incremental": q_dedup_incremental,
    "dedup_stats": q_dedup_stats,
    "reindex_ids": q_reindex_ids,
    "sections_sharded": q_sections_sharded,
    "metadata_build": q_metadata_build,
    "corpus_stats": q_corpus_stats,
    "dev_slice": q_dev_slice,
    "encode_hash": q_encode_hash,
    "encode_norm": q_encode_norm,
    "query_text": q_query_text,
    "passage_text": q_passage_text,
    "knn_flat": q_knn_flat,
    "knn_sharded": q_knn_sharded,
    "knn_pruned": q_knn_pruned,
    "knn_pruned_cells": q_knn_pruned_cells,
    "knn_recall": q_knn_recall,
    "knn_bytes": q_knn_bytes,
    "articles_by_id": q_articles_by_id,
    "vector_shards": q_vector_shards,
    "vectors_scan": q_vectors_scan,
    "shard_offsets": q_shard_offsets,
    "select_articles": q_select_articles,
    "hit_files": q_hit_files,
    "load_articles": q_load_articles,
    "split_lines": q_split_lines,
    "sectionize": q_sectionize,
    "rerank_lines": q_rerank_lines,
    "context_dataset": q_context_dataset,
    "context_csv": q_context_csv,
    "questions_load": q_questions_load,
    "fill_options": q_fill_options,
    "drop_rows": q_drop_rows,
    "shuffle_rows": q_shuffle_rows,
    "union_train": q_union_train,
    "mc_pairs": q_mc_pairs,
    "mc_pairs_answers": q_mc_pairs_answers,
    "truncate_pairs": q_truncate_pairs,
    "token_lengths": q_token_lengths,
    "eval_map3": q_eval_map3,
    "pred_letters": q_pred_letters,
    "pred_csv": q_pred_csv,
    "dev_prompt": q_dev_prompt,
    "prepare_split": q_prepare_split,
    "questions_unlabeled": q_questions_unlabeled,
    "sections_scan": q_sections_scan,
    "articles_sorted": q_articles_sorted,
    "sectionize_sorted": q_sectionize_sorted,
    "query_text_bge": q_query_text_bge,
    "mc_pairs_shuffled": q_mc_pairs_shuffled,
    "knn_nan": q_knn_nan,
    "sink_modes": q_sink_modes,
    "sink_outcomes": q_sink_outcomes,
    "output_named": q_output_named,
    "dev_slice_500": q_dev_slice_500,
    "prepare_split_head": q_prepare_split_head,
    "encode_batches": q_encode_batches,
    "context_two_encoders": q_context_two_encoders,
    "truncate_pairs_subword": q_truncate_pairs_subword,
    "token_lengths_subword": q_token_lengths_subword,
}
