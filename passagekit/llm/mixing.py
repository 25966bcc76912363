"""Mixing sources to target weights by hierarchical budgeting (native).

Leaves are (domain, language, source). A token budget flows down the tree by
sibling weights. A subtree can take at most its supply times ``max_epochs``;
what it cannot take goes to its siblings in proportion to their weights
(water-filling), and only what all siblings together cannot take is left to the
parent's siblings, because each parent's own limit is the sum of its children's.

A leaf's budget buys whole passes over its documents and then the prefix, by
tokens, of one more pass in a seeded hash order. The prefix is found with two
aggregates instead of a sort of the leaf: tokens per hash bucket locate the
bucket where the budget ends, further hash digits split that bucket until it
holds at most ``EDGE_ROWS`` rows, and only those are ranked. A leaf with a third
of all rows is therefore never in one task, whatever the number of rows.

Defined results: null and empty texts hold 0 tokens, so rows of 0 tokens that
come first in the order fit into any rest; no row is taken more than
``max_epochs`` times; a leaf without tokens is taken once; null domain, language or
source counts as the empty name; rows that repeat an id (or lack one) share a
place in the order and are taken together or not at all; an empty table gives
an empty result; extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, documents, staged

BUCKETS = 3                  # hexadecimal digits: 4096 hash buckets a leaf, as many in each further split
EDGE_ROWS = 10_000           # rows ranked in one task
DIGITS = 32                  # of a hash
LEAF_BROADCAST = 100_000     # leaves (about 100 bytes each) that may be broadcast, checked by a count
LEVELS = ["domain", "lang", "source"]

# What the queries mix: target weights and where a source belongs.
DOMAIN_WEIGHTS = {"web": 5, "books": 3, "code": 2}
LANG_WEIGHTS = {"en": 6, "de": 2, "fr": 2, "es": 2}
MAX_EPOCHS = 4


def domain_of(source: Column) -> Column:
    """Domain of a source named by a number: the number modulo 3."""
    no = F.regexp_extract(source, "([0-9]+)$", 1).try_cast("long") % 3
    return F.when(no == 0, "web").when(no == 1, "books").when(no == 2, "code").otherwise("other")


def weight_of(col: Column, weights: dict[str, int]) -> Column:
    out = F.lit(1)
    for name, w in weights.items():
        out = F.when(col == name, w).otherwise(out)
    return out.cast("double")


def waterfill(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Budget of each sibling from its ``w``, ``cap`` and parent's ``parent_budget``.

    With siblings in the order of cap / w, the water level is the largest
    (budget - caps before) / (weights from here on).
    """
    order = Window.partitionBy(*parent).orderBy(F.col("cap") / F.col("w"), name)
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    ahead = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = F.max((F.col("parent_budget") - F.col("before")) / F.col("ahead")).over(Window.partitionBy(*parent))
    return (nodes.withColumn("before", before).withColumn("ahead", ahead).withColumn("level", level)
            .withColumn("budget", F.least(F.col("cap"), F.col("level") * F.col("w"))).drop("before", "ahead", "level"))


def leaf_budgets(supply: DataFrame, total_share: float, max_epochs: int,
                 weights: dict[str, dict[str, int]]) -> DataFrame:
    """``domain, lang, source, supply, budget, passes, rest``: ``passes`` whole
    epochs and ``rest`` tokens of the next."""
    leaves = supply.withColumn("cap", F.col("supply").cast("double") * max_epochs)
    total = supply.agg((F.sum("supply") * F.lit(total_share)).cast("double").alias("parent_budget"))
    up = None
    for i, level in enumerate(LEVELS):
        keys = LEVELS[:i + 1]
        nodes = leaves.groupBy(*keys).agg(F.sum("cap").alias("cap"), F.sum("supply").alias("supply"))
        nodes = nodes.withColumn("w", weight_of(F.col(level), weights.get(level, {})))
        if up is None:
            nodes = nodes.withColumn("parent_budget", total.scalar())
        else:
            nodes = nodes.join(up.select(*LEVELS[:i], F.col("budget").alias("parent_budget")), LEVELS[:i])
        up = waterfill(nodes, LEVELS[:i] or [F.lit(0)], level)
    budget = F.floor("budget").cast("long")
    passes = F.when(F.col("supply") > 0, F.floor(budget / F.col("supply"))).otherwise(0).cast("long")
    return (up.withColumn("passes", passes).withColumn("budget", budget)
            .withColumn("rest", F.col("budget") - F.col("passes") * F.col("supply"))
            .select(*LEVELS, "supply", "budget", "passes", "rest"))


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed).cast("string"), epoch.cast("string"),
                             F.coalesce(doc_id.cast("string"), F.lit(""))))


def plan_mixture(docs: DataFrame, domain: Column, total_share: float = 1.0, max_epochs: int = MAX_EPOCHS,
                 weights: dict[str, dict[str, int]] | None = None, seed: int = 0) -> DataFrame:
    """Rows of ``docs`` as a struct ``row`` with their leaf, ``tokens``, the
    leaf's ``budget`` and ``copies``: how many epochs take the row."""
    weights = {"domain": DOMAIN_WEIGHTS, "lang": LANG_WEIGHTS} if weights is None else weights
    name = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"),
        name(domain).alias("domain"), name(F.col("lang")).alias("lang"), name(F.col("source")).alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("tokens"))
    slim = staged(rows.drop("row"), "mix_rows")
    leaves = staged(leaf_budgets(slim.groupBy(*LEVELS).agg(F.sum("tokens").alias("supply")),
                                 total_share, max_epochs, weights), "leaves")
    small = leaves.count() <= LEAF_BROADCAST
    put = F.broadcast if small else (lambda x: x)
    key = order_key(seed, F.col("passes"), F.col("id"))
    keyed = slim.join(put(leaves), LEVELS).withColumn("h", key)
    digits, within = BUCKETS, keyed.withColumn("before", F.lit(0).cast("long"))
    while True:
        bucket = F.substring("h", 1, digits)
        per_bucket = within.groupBy(*LEVELS, "rest", "before", bucket.alias("bucket")).agg(
            F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"))
        upto = F.col("before") + F.sum("t").over(Window.partitionBy(*LEVELS).orderBy("bucket"))
        edge = (per_bucket.withColumn("upto", upto)
                .where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("t") <= F.col("rest")))
                .select(*LEVELS, F.col("bucket").alias("edge"), (F.col("upto") - F.col("t")).alias("before"), "n"))
        edge = staged(edge, "edge")
        # rows of the bucket where each leaf's budget ends
        within = keyed.join(put(edge), LEVELS).where(F.substring("h", 1, digits) == F.col("edge"))
        if (edge.agg(F.max("n")).first()[0] or 0) <= EDGE_ROWS or digits >= DIGITS:
            break
        within = within.drop("edge", "n")
        digits = min(digits + BUCKETS, DIGITS)
    edge = edge.drop("n")
    # equal places share one running sum
    run = F.sum("tokens").over(Window.partitionBy(*LEVELS).orderBy("h", "id"))
    last = (within.withColumn("upto", F.col("before") + run).where(F.col("upto") <= F.col("rest"))
            .groupBy(*LEVELS).agg(F.max("h").alias("last")))
    cut = staged(leaves.join(edge, LEVELS, "left").join(last, LEVELS, "left"), "cut")
    # without an edge the leaf holds no tokens: the extra pass takes all of it
    bucket = F.substring("h", 1, digits)
    taken = (bucket < F.col("edge")) | ((bucket == F.col("edge")) & (F.col("h") <= F.col("last")))
    copies = F.col("passes") + (F.col("edge").isNull() | F.coalesce(taken, F.lit(False))).cast("long")
    return (rows.join(put(cut), LEVELS).withColumn("h", key)
            .withColumn("copies", F.least(copies, F.lit(max_epochs)).cast("int"))
            .select("row", *LEVELS, "tokens", "budget", "copies"))


def mix(docs: DataFrame, domain: Column, max_epochs: int = MAX_EPOCHS, **options) -> DataFrame:
    """The mixture: rows of ``docs``, once per epoch that takes them."""
    plan = plan_mixture(docs, domain, max_epochs=max_epochs, **options).where("copies > 0")
    return plan.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("epoch")).select("row.*")


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    plan = plan_mixture(docs, domain_of(F.col("source")))
    return plan.select("row.doc_id", *LEVELS, "tokens", "budget", "copies")


def _case(col: str, weights: dict[str, int]) -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 1 END::DOUBLE"


def _level(parent: str, name: str, weight: str, src: str) -> str:
    by = f"PARTITION BY {parent}" if parent else ""
    return f"""
  SELECT *, least(cap, max((pb - bef) / ahead) OVER ({by}) * w) AS b FROM (
    SELECT *, coalesce(sum(cap) OVER ({by} ORDER BY cap / w, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef,
           sum(w) OVER ({by} ORDER BY cap / w, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ahead
    FROM (SELECT *, {weight} AS w FROM ({src})))"""


ORACLE = f"""
WITH r AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         CASE TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT) % 3
              WHEN 0 THEN 'web' WHEN 1 THEN 'books' WHEN 2 THEN 'code' ELSE 'other' END AS domain,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS tokens
  FROM documents),
leaf AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS supply, sum(tokens)::DOUBLE * {MAX_EPOCHS} AS cap FROM r GROUP BY ALL),
l1 AS ({_level('', 'domain', _case('domain', DOMAIN_WEIGHTS), 'SELECT domain, sum(cap) AS cap, (SELECT sum(supply)::DOUBLE FROM leaf) AS pb FROM leaf GROUP BY domain')}),
l2 AS ({_level('domain', 'lang', _case('lang', LANG_WEIGHTS), 'SELECT leaf.domain, lang, sum(leaf.cap) AS cap, any_value(b) AS pb FROM leaf JOIN l1 USING (domain) GROUP BY ALL')}),
l3 AS ({_level('domain, lang', 'source', '1.0::DOUBLE', 'SELECT leaf.domain, leaf.lang, source, supply, leaf.cap AS cap, b AS pb FROM leaf JOIN l2 USING (domain, lang)')}),
bud AS (SELECT domain, lang, source, supply, floor(b)::BIGINT AS budget,
               CASE WHEN supply > 0 THEN floor(b)::BIGINT // supply ELSE 0 END AS passes FROM l3),
k AS (SELECT r.*, budget, passes, budget - passes * supply AS rest,
             md5('0:' || passes::VARCHAR || ':' || coalesce(doc_id::VARCHAR, '')) AS h
      FROM r JOIN bud USING (domain, lang, source))
SELECT doc_id, domain, lang, source, tokens, budget,
       least(passes + CASE WHEN sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY h, doc_id) <= rest THEN 1 ELSE 0 END,
             {MAX_EPOCHS})::INTEGER AS copies
FROM k
"""
