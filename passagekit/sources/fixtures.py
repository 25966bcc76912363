"""Inputs derived from the driver's tables (same rules as the SQL oracle).

The driver ships generic tables; these functions turn them into the shapes the
corpus/retrieval jobs consume. Every rule is a Spark expression over the whole
table, so derived inputs grow with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values of the derivation (shared with the SQL oracle)
# ---------------------------------------------------------------------------
LONG_HEADING = "== " + "Very " * 20 + "=="       # 105 chars: dropped heading
DOUBLE_HEADING = "== " + "Long " * 12 + "=="     # 65 chars: kept twice
DEEP_HEADING = "======== Deep ========"           # appended heading
SHORT_HEADING = "= X ="                           # dropped heading
REFERENCES_LINE = "== References =="
DISAMBIGUATION_PREFIX = "This may refer to: "
SHORT_LINE_MAX = 40          # lines of 1..40 chars become headings
QUERY_EVERY = 20             # vectors with vec_id % 20 = 0 are queries
VECTORS_PER_META_FILE = 100  # metadata file of a vector = vec_id div 100
OPTION_CHARS = 30            # option text = first 30 chars of an item
NULL_C_EVERY = 7             # option C is null when item_id % 7 = 0
BAD_SHAPE_EVERY = 11         # api body '{"k": 1}'
BAD_JSON_EVERY = 13          # api body 'not json'
# ---------------------------------------------------------------------------


def articles(documents: DataFrame) -> DataFrame:
    """``(doc_id, text)``: documents with headings, references, braces and
    padding planted line by line (first matching rule wins)."""
    # Row-level values enter the lambda through the zipped argument (computed
    # once per row); referencing them inside the lambda would re-evaluate
    # the split for every line.
    lines = F.split(F.col("text"), "\n", -1)
    n = F.size(lines)
    ctx = F.arrays_zip(lines.alias("l"),
                       F.array_repeat(F.floor(n / 2).cast("int"), n).alias("mid"),
                       F.array_repeat(F.pmod(F.col("doc_id"), F.lit(10)).cast("int"), n).alias("m"))

    def rule(c, i):
        line, at_mid, m = c["l"], i == c["mid"], c["m"]
        return (F.when(at_mid & (m == 2), F.lit(LONG_HEADING))
                .when((i == 0) & (m == 3), F.concat(F.lit(DISAMBIGUATION_PREFIX), line))
                .when(at_mid & (m == 4), F.concat(F.lit("{"), line, F.lit("}")))
                .when(at_mid & (m == 5), F.lit(DEEP_HEADING))
                .when(at_mid & (m == 6), F.lit(DOUBLE_HEADING))
                .when(at_mid & (m == 7), F.lit(SHORT_HEADING))
                .when(at_mid & (m == 8), F.lit(REFERENCES_LINE))
                .when(at_mid & (m == 9), F.concat(F.lit("  "), line, F.lit("  ")))
                .when(F.length(line).between(1, SHORT_LINE_MAX),
                      F.concat(F.lit("== "), F.regexp_replace(line, r"\.+$", ""), F.lit(" ==")))
                .otherwise(line))

    return documents.select("doc_id", F.array_join(F.transform(ctx, rule), "\n").alias("text"))


def api_responses(documents: DataFrame) -> DataFrame:
    """``(doc_id, body)``: API-style JSON around each document's text, with
    two kinds of unusable bodies planted."""
    good = F.to_json(F.struct(F.struct(
        F.create_map(F.col("doc_id").cast("string"), F.struct(F.col("text").alias("extract")))
        .alias("pages")).alias("query")))
    body = (F.when(F.pmod("doc_id", F.lit(BAD_SHAPE_EVERY)) == 0, F.lit('{"k": 1}'))
            .when(F.pmod("doc_id", F.lit(BAD_JSON_EVERY)) == 0, F.lit("not json"))
            .otherwise(good))
    return documents.select("doc_id", body.alias("body"))


def vectors(embeddings: DataFrame) -> DataFrame:
    """``(id, embedding)`` from the driver's embeddings."""
    return embeddings.select(F.col("vec_id").alias("id"), "embedding")


def vector_queries(embeddings: DataFrame) -> DataFrame:
    """``(prompt_id, embedding)``: every 20th vector, keyed by its own id."""
    return (embeddings.where(F.pmod("vec_id", F.lit(QUERY_EVERY)) == 0)
            .select(F.col("vec_id").alias("prompt_id"), "embedding"))


def questions(benchmark: DataFrame) -> DataFrame:
    """``(prompt_id, prompt, A, B, C, D, E, answer)`` from ``benchmark``.

    Option j (A=0 .. E=4) of item i is the first 30 characters of item
    ``(i + j) mod n``. Built by sending each item's prefix to the five
    questions that use it and pivoting, so no self-join is needed.
    """
    n = benchmark.select(F.count(F.lit(1))).scalar()
    sent = benchmark.select(
        F.posexplode(F.array_repeat(F.substring("text", 1, OPTION_CHARS), 5)).alias("j", "opt"),
        F.col("item_id"))
    sent = sent.select(F.pmod(F.col("item_id") - F.col("j"), n).alias("owner"), "j", "opt")
    letters = "ABCDE"
    opts = sent.groupBy("owner").agg(*[
        F.max(F.when(F.col("j") == j, F.col("opt"))).alias(letters[j]) for j in range(5)])
    q = benchmark.join(opts, benchmark["item_id"] == opts["owner"], "inner")
    return q.select(
        F.col("item_id").alias("prompt_id"),
        F.col("text").alias("prompt"),
        "A", "B",
        F.when(F.pmod("item_id", F.lit(NULL_C_EVERY)) == 0, F.lit(None).cast("string"))
        .otherwise(F.col("C")).alias("C"),
        "D", "E",
        F.substring(F.lit(letters), (F.pmod("item_id", F.lit(5)) + 1).cast("int"), 1).alias("answer"),
    )


def predictions(embeddings: DataFrame) -> DataFrame:
    """``(id, preds array<double>[5], label)``: model scores stand-in."""
    return embeddings.select(
        F.col("vec_id").alias("id"),
        F.transform(F.slice("embedding", 1, 5), lambda x: x.cast("double")).alias("preds"),
        F.pmod("label", F.lit(5)).cast("int").alias("label"),
    )
