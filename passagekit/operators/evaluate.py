"""Scoring of multiple-choice predictions (row-local, no window).

NaN scores are treated as -Infinity before ranking, so a NaN never wins;
ties go to the lower option index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import index_to_letter


def _clean(preds: Column) -> Column:
    return F.transform(preds, lambda x: F.when(F.isnan(x), F.lit(float("-inf"))).otherwise(x))


def label_rank(preds: Column, label: Column) -> Column:
    """1-based rank of the label's score in descending order."""
    p = _clean(preds)
    # the label's score enters the lambda zipped (evaluated once per row)
    z = F.arrays_zip(p.alias("x"), F.array_repeat(F.element_at(p, label + 1), F.size(preds)).alias("s"))
    return 1 + F.size(F.filter(z, lambda e, i: (e["x"] > e["s"]) | ((e["x"] == e["s"]) & (i < label))))


def argmax(preds: Column) -> Column:
    """0-based index of the first maximum."""
    p = _clean(preds)
    return F.array_position(p, F.array_max(p)) - 1


def with_scores(df: DataFrame, preds: str = "preds", label: str = "label", k: int = 3) -> DataFrame:
    r = label_rank(F.col(preds), F.col(label))
    return df.withColumn("label_rank", r).withColumn(
        "ap", F.when(r <= k, F.lit(1.0) / r).otherwise(F.lit(0.0))).withColumn(
        "correct", (argmax(F.col(preds)) == F.col(label)).cast("double"))


def map_at_k(df: DataFrame, k: int = 3, preds: str = "preds", label: str = "label") -> DataFrame:
    """One row: ``(n, map_at_3, accuracy)``."""
    s = with_scores(df, preds, label, k)
    # rounded to 9 decimals: sums of 1/r are order-sensitive in the last bits
    return s.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("ap"), 9).alias(f"map_at_{k}"),
                 F.round(F.avg("correct"), 9).alias("accuracy"))


def accuracy(df: DataFrame, preds: str = "preds", label: str = "label") -> DataFrame:
    return with_scores(df, preds, label).agg(F.round(F.avg("correct"), 9).alias("accuracy"))


def pred_letters(df: DataFrame, preds: str = "preds", label: str = "label", id_col: str = "id") -> DataFrame:
    """``(id, pred, label)`` as letters A-E (first maximum wins)."""
    return df.select(id_col, index_to_letter(argmax(F.col(preds))).alias("pred"),
                     index_to_letter(F.col(label)).alias("label"))
