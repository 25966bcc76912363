"""Training-data pipeline: five stages over ``documents``.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run``
writes each stage's result to the shared folder and reads it back as the next
stage's input, so a lost executor never repeats an earlier stage.

Defined results: rows with a null, empty or blank text fail the base rule of the
first stage and go; nulls in other columns are carried along, a null language or
source mixes as the empty name; of rows that copy each other, with or without an
id, one stays; rows that share an id but not a text are separate documents; an
empty table gives an empty result with the columns of the last stage; extra
columns pass through all stages, whatever their names, except that the last one
replaces columns named like its own (``law``, ``shard``, ``slot``, ``grown_shard``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagekit.llm import decontamination, mixing, quality_rules, sharding, simhash
from passagekit.llm.common import documents, staged, table

# The mixture of the last selection: no repeats after deduplication, and nine
# tenths of the tokens, so that scarce branches hand their budget on.
MIX_SHARE, MIX_EPOCHS = 0.9, 1


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the learned decision list keep."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: the one with the smallest id."""
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontamination.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents chosen to the target weights of domain, language and source."""
    return mixing.mix(docs, mixing.domain_of(F.col("source")), total_share=MIX_SHARE, max_epochs=MIX_EPOCHS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and place in it."""
    return sharding.shard_rows(docs)


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("decontamination", decontaminate),
          ("mixing", mix), ("sharding", shard)]

# Learned rules, SimHash components, edit distances and seeded draws are not
# SQL; tests/llm holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
