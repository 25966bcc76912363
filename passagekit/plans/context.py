"""Shared inputs for the registered queries: one lazily built DataFrame per
stage over a test data directory (derived by Spark from the driver tables)."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ..operators import corpus, encode
from ..session import load, scratch_path
from ..sources import fixtures as fx
from . import corpus_build, index_build, retrieval

ROWS_PER_FILE = 250          # small stand-in for 250,000 rows per file
RETRIEVER_K = 20
CONTEXT_TOP_K = 35
ENCODER_DIM = 256
QUERY_MODEL = "intfloat/e5-base-v2"   # model named by the retrieval config


class Inputs:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self.encoder = encode.HashingEncoder(ENCODER_DIM)

    def t(self, name: str, spread: bool = True) -> DataFrame:
        return load(self.spark, self.sf_dir, name, spread)

    # ---- corpus -------------------------------------------------------------
    @cached_property
    def articles(self) -> DataFrame:
        return fx.articles(self.t("documents"))

    @cached_property
    def sections_all(self) -> DataFrame:
        return corpus.article_sections(self.articles)

    @cached_property
    def kept(self) -> DataFrame:
        return corpus.filter_sections(self.sections_all)

    @cached_property
    def staged(self) -> DataFrame:
        """Parsed, filtered sections with text hash, written once."""
        return corpus_build.stage_sections(self.articles, scratch_path(self.spark, "staged"))

    @cached_property
    def corpus(self) -> DataFrame:
        """Deduplicated sections ``(id, text, first_sentence, file, id1, doc_id,
        sec)``, written partitioned by ``file``."""
        path = scratch_path(self.spark, "sections")
        survivors = corpus_build.survivor_keys(self.staged, ROWS_PER_FILE)
        corpus_build.write_sections_colocated(self.staged, survivors, path)
        return self.spark.read.parquet(path)

    @cached_property
    def meta(self) -> DataFrame:
        return corpus.metadata(self.corpus)

    # ---- questions and search -------------------------------------------------
    @cached_property
    def questions(self) -> DataFrame:
        return fx.questions(self.t("benchmark", spread=False))

    @cached_property
    def section_vectors(self) -> DataFrame:
        """The index: ``(id, embedding)`` written once."""
        return index_build.build_index(self.corpus, self.encoder, scratch_path(self.spark, "index"))

    @cached_property
    def retrieval(self) -> retrieval.Retrieval:
        return retrieval.retrieve_contexts(self.questions, self.corpus, self.meta, self.section_vectors,
                                           self.encoder, RETRIEVER_K, CONTEXT_TOP_K)

    @property
    def query_vectors(self) -> DataFrame:
        return self.retrieval.query_vectors

    @property
    def hits(self) -> DataFrame:
        return self.retrieval.hits

    @property
    def selected(self) -> DataFrame:
        return self.retrieval.selected

    @property
    def loaded(self) -> DataFrame:
        return self.retrieval.loaded

    @property
    def lines(self) -> DataFrame:
        return self.retrieval.lines

    @property
    def ranked(self) -> DataFrame:
        return self.retrieval.ranked

    @property
    def contexts(self) -> DataFrame:
        return self.retrieval.contexts

    # ---- vectors ---------------------------------------------------------------
    @cached_property
    def embeddings(self) -> DataFrame:
        return self.t("embeddings")

    @cached_property
    def predictions(self) -> DataFrame:
        return fx.predictions(self.embeddings)

