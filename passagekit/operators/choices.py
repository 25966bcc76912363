"""Multiple-choice data preparation: fill, shuffle, drop, union, model
input pairs, truncation and token statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import LETTERS, letter_to_index
from ..session import scratch_path
from .corpus import dense_index_ranges
from .encode import tokens
from .tokens import fit_pair, token_count

OPTIONS = list(LETTERS)
# Input pair templates.
#   first  (plain):        "[CLS] {context}"
#   second (plain):        " #### {prompt} [SEP] {option} [SEP]"
#   first  (with answers): "[CLS] {o1}(o) {o2}(o) {o3}(o) {o4} ### {context}"
#   second (with answers): " ### {prompt} [SEP] {option} [SEP]"
PAIR_FIRST = "[CLS] "
SECOND_PLAIN = " #### "
SECOND_ANSWERS = " ### "
SEP = " [SEP] "
END = " [SEP]"
OTHER_OPTIONS_JOIN = "(o) "
OTHER_OPTIONS_END = " ### "
MISSING_OPTION = "None"


def fill_options(df: DataFrame, value: str = MISSING_OPTION) -> DataFrame:
    return df.fillna(value, subset=OPTIONS)


def shuffle_rows(df: DataFrame, seed: int, id_col: str = "prompt_id", rows_per_range: int = 250_000) -> DataFrame:
    """Reproducible permutation: rows ordered by a seeded hash of their id
    (unique).

    Adds ``shuffle_key`` and ``position`` (0-based place in the new order). Rows
    are dealt into ranges of the key of about ``rows_per_range`` rows, so the
    number of tasks follows the data, and written in their new order."""
    key = F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed))))
    return dense_index_ranges(df.withColumn("shuffle_key", key), ["shuffle_key", id_col], "position",
                              scratch_path(df.sparkSession, "shuffled"), rows_per_range)


def drop_rows(df: DataFrame, ids: list[int], id_col: str = "prompt_id") -> DataFrame:
    """Remove rows at explicit positions (ids assigned at ingest)."""
    return df.where(~F.col(id_col).isin(list(ids)))


def union_train(train: DataFrame, valid: DataFrame, id_col: str = "prompt_id") -> DataFrame:
    """Rows of both splits with a new row index ``row_id``: the first split
    keeps its positions, the second's follow after the last of them."""
    after = F.coalesce(train.select(F.max(id_col)).scalar() + 1, F.lit(0)).cast("long")
    first = train.withColumn("row_id", F.col(id_col).cast("long"))
    return first.unionByName(valid.withColumn("row_id", F.col(id_col) + after), allowMissingColumns=True)


def prepare_split(train: DataFrame, valid: DataFrame, drop: list[int], seed: int, n: int | None = None) -> DataFrame:
    """The whole preparation in order: drop rows of the first split by their
    original position, concatenate with a new row index, shuffle, keep the
    first ``n`` rows (all when null), fill missing options."""
    rows = shuffle_rows(union_train(drop_rows(train, drop), valid), seed, "row_id")
    if n is not None:
        rows = rows.where(F.col("position") < n)
    return fill_options(rows)


def _opt(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(MISSING_OPTION))


def mc_pairs(df: DataFrame, with_answers: bool = False, shuffle_seed: int | None = None) -> DataFrame:
    """Five model input pairs per question: ``(prompt_id, choice, first,
    second, label)``.

    ``with_answers`` puts the four other options before the context; they
    keep their order unless ``shuffle_seed`` is given (then a seeded hash
    orders them, reproducibly).
    """
    opts = F.array(*[_opt(c) for c in OPTIONS])
    base = df.select("prompt_id", "prompt", "context", "answer", F.posexplode(opts).alias("choice", "option"),
                     opts.alias("_opts"))
    if with_answers:
        others = F.filter(F.col("_opts"), lambda x, i: i != F.col("choice"))
        if shuffle_seed is not None:
            keyed = F.transform(others, lambda x, i: F.struct(
                F.md5(F.concat_ws(":", F.lit(str(shuffle_seed)), F.col("prompt_id").cast("string"),
                                  F.col("choice").cast("string"), i.cast("string"))).alias("k"), x.alias("v")))
            others = F.transform(F.array_sort(keyed), lambda s: s["v"])
        first = F.concat(F.lit(PAIR_FIRST), F.array_join(others, OTHER_OPTIONS_JOIN),
                         F.lit(OTHER_OPTIONS_END), F.col("context"))
        lead = SECOND_ANSWERS
    else:
        first = F.concat(F.lit(PAIR_FIRST), F.col("context"))
        lead = SECOND_PLAIN
    second = F.concat(F.lit(lead), F.col("prompt"), F.lit(SEP), F.col("option"), F.lit(END))
    return base.select("prompt_id", "choice", first.alias("first"), second.alias("second"),
                       letter_to_index(F.col("answer")).alias("label"))


def word_count(c: Column) -> Column:
    return F.size(F.split(c, " ", -1))


def truncate_pairs(pairs: DataFrame, max_tokens: int, tokenizer=None) -> DataFrame:
    """Cut only ``first`` so that both texts fit ``max_tokens`` tokens;
    ``over_budget`` flags pairs whose second text alone is too long.

    Tokens are space-separated words (native), or those of ``tokenizer``
    (:mod:`.tokens`)."""
    if tokenizer is not None:
        fit = fit_pair(F.col("first"), F.col("second"), max_tokens, tokenizer)
        return pairs.withColumn("_f", fit).select("prompt_id", "choice", F.col("_f.first").alias("first"), "second", "label", "_f.over_budget")
    budget = F.greatest(F.lit(max_tokens) - word_count(F.col("second")), F.lit(0))
    cut = F.array_join(F.slice(F.split(F.col("first"), " ", -1), 1, budget), " ")
    return pairs.select("prompt_id", "choice",
                        F.when(word_count(F.col("first")) <= budget, F.col("first")).otherwise(cut).alias("first"),
                        "second", "label",
                        (word_count(F.col("second")) > max_tokens).alias("over_budget"))


def token_lengths(df: DataFrame, by: str, text_col: str = "text", tokenizer=None) -> DataFrame:
    """Token statistics per group: ``(by, n, min/avg/max tokens,
    chars_per_token)``, tokens being the encoder's word tokens or those of
    ``tokenizer``."""
    count = F.size(tokens(F.col(text_col))) if tokenizer is None else token_count(F.col(text_col), tokenizer)
    t = df.select(by, count.alias("ntok"), F.length(text_col).alias("nchar"))
    return t.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.min("ntok").alias("min_tokens"),
        F.round(F.avg("ntok"), 6).alias("avg_tokens"), F.max("ntok").alias("max_tokens"),
        F.round(F.sum("nchar") / F.greatest(F.sum("ntok"), F.lit(1)), 6).alias("chars_per_token"))
