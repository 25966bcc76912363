"""Sinks and save modes.

Save modes: ``overwrite`` (rebuild), ``errorifexists`` (refuse to clobber a
finished collection), ``ignore`` (skip work that is already done).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTEXT_COLUMNS = ["prompt", "context", "A", "B", "C", "D", "E", "answer"]


def write_sections(df: DataFrame, path: str, mode: str = "overwrite",
                   extra_columns: list[str] | None = None) -> None:
    """One Parquet directory per ``file`` value (250,000 rows each by default);
    repartitioning by ``file`` makes one output file per directory."""
    (df.select("id", "text", "first_sentence", "file", *(extra_columns or [])).repartition("file")
     .sortWithinPartitions("id").write.mode(mode).partitionBy("file").parquet(path))


def write_metadata(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.select(F.col("id").cast("long"), F.col("file").cast("int")).write.mode(mode).parquet(path)


def write_vectors(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Vectors, partitioned by ``shard`` when the column is present."""
    w = df.write.mode(mode)
    if "shard" in df.columns:
        df = df.repartitionByRange("shard", "id")      # a shard may be written by several tasks
        w = df.write.mode(mode).partitionBy("shard")
    w.parquet(path)


def write_csv(df: DataFrame, path: str, columns: list[str], mode: str = "overwrite") -> None:
    """Header, ``"`` quoting/escaping, values written verbatim (Spark trims
    outer white space by default when writing CSV; we keep it)."""
    (df.select(*columns).write.mode(mode).option("header", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .csv(path))


def write_context_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    write_csv(df, path, CONTEXT_COLUMNS, mode)


def write_predictions_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    write_csv(df, path, ["pred", "label"], mode)


def output_name(out_dir: str, index_name: str, split: str, model: str, k: int, corpus_version: str,
                sharded: bool = False) -> str:
    """Output path from run parameters (the name the retrieval job writes to)."""
    base = index_name.split("/")[-1]
    base = base + "_sharded" if sharded else base.split(".")[0]
    model_short = model.split("/")[-1]
    return f"{out_dir}/{base}__{split.split('.')[0]}_{model_short}_{k}_{corpus_version}.csv"
