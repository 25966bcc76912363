"""Language identification by Bayesian evidence fusion.

Four pieces of evidence about a page: the likelihood of its text under character
trigram models, the language its markup declares, its address suffix, and a
prior of its host. How far a declaration or a suffix is to be believed is not
assumed but counted: both likelihoods come from grouped sums of the text
posteriors over all pages. The host's prior is smoothed hierarchically (all
pages, registered domain, host) and leaves the page itself out.

The trigram models are fitted on a bounded sample: at most ``sample`` labelled
documents, in the order of a hash of their id; all counts over pages cover every
page.

Defined results: null and empty html has no text evidence, no declaration is a
value of its own, and so is a missing host; such pages follow their other
evidence and the prior. Long pages are read whole; repeated rows are judged
alike; an empty page table gives an empty result; without labelled documents the
language is null. Extra columns are ignored.
"""

from __future__ import annotations

import html as markup
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, documents, in_sample, staged, table

SAMPLE = 4000
BUCKETS = 1 << 16            # hashed trigrams of a model
EFFECTIVE = 100              # trigrams count as at most so many independent draws
HOST_WEIGHT, DOMAIN_WEIGHT, SMOOTH = 5.0, 20.0, 1.0

_DROP = re.compile(r"<(script|style|nav|footer|header|aside)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", re.I | re.S)


def visible(page: str | None) -> str:
    """Running text of a page: scripts, styles, navigation and tags removed."""
    return markup.unescape(_DROP.sub(" ", page)) if page else ""


def trigrams(text: str) -> np.ndarray:
    """Buckets of the character trigrams of a lower-cased text, letters only."""
    t = " ".join(re.findall(r"[^\W\d_]+", text.lower()))
    c = np.frombuffer(f" {t} ".encode("utf-32-le", "replace"), np.uint32).astype(np.uint64) if t else np.zeros(0, np.uint64)
    if len(c) < 3:
        return np.zeros(0, np.int64)
    h = (c[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ c[1:-1] * np.uint64(0xD1342543DE82EF95)) + c[2:] * np.uint64(0xBF58476D1CE4E5B9)
    return (((h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)) >> np.uint64(48)).astype(np.int64)


def train(docs: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages and their trigram log probabilities (languages x buckets)."""
    rows = docs.where(F.col("doc_id").isNotNull() & (F.col("lang") != "") & F.col("text").isNotNull())
    ids = staged(rows.select("doc_id"), "ids")
    picked = ids.where(in_sample(ids, "doc_id", sample)).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # at most ``sample`` ids are broadcast; only their texts move
    rows = rows.select("doc_id", "lang", "text").join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id"])

    def count(batches):
        for b in batches:
            total: dict[str, np.ndarray] = {}
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                total.setdefault(lang, np.zeros(BUCKETS, np.int64))
                total[lang] += np.bincount(trigrams(text), minlength=BUCKETS)
            for lang, n in total.items():
                at = np.flatnonzero(n)
                yield {"lang": [lang] * len(at), "bucket": at, "n": n[at]}

    counts = arrow_map(rows, count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = counts.orderBy("lang", "bucket").collect()
    langs = sorted({r["lang"] for r in got})
    model = np.full((len(langs), BUCKETS), 0.5)
    for r in got:
        model[langs.index(r["lang"]), r["bucket"]] += r["n"]
    return langs, np.log(model / model.sum(axis=1, keepdims=True))


def text_evidence(pages: DataFrame, langs: list[str], model: np.ndarray) -> DataFrame:
    """``page_id, ll`` (log likelihood by language), ``declared, suffix, domain, host``."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        for b in batches:
            out = []
            for page in b.column("html").to_pylist():
                g = trigrams(visible(page))
                n = len(g)
                ll = shared.value[:, g].sum(axis=1) * (min(n, EFFECTIVE) / n) if n else np.zeros(len(langs))
                out.append((ll - ll.max()).tolist() if len(langs) else [])
            yield {"page_id": b.column("page_id"), "ll": out, "declared": b.column("declared"), "host": b.column("host")}

    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    declared = F.lower(F.regexp_extract("html", r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", 1))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "html",
                        F.coalesce(declared, F.lit("")).alias("declared"), F.coalesce(host, F.lit("")).alias("host"))
    out = arrow_map(rows, score, "page_id long, ll array<double>, declared string, host string")
    return out.withColumn("suffix", F.substring_index("host", ".", -1)).withColumn("domain", F.substring_index("host", ".", -2))


def _sums(n: int, col: str = "post") -> list:
    return F.array(*[F.sum(F.col(col)[i]) for i in range(n)])


def _normal(logs):
    """Probabilities from an array of logs."""
    top = F.array_max(logs)
    e = F.transform(F.arrays_zip(logs.alias("x"), F.array_repeat(top, F.size(logs)).alias("m")), lambda v: F.exp(v["x"] - v["m"]))
    return F.transform(F.arrays_zip(e.alias("x"), F.array_repeat(F.aggregate(e, F.lit(0.0), lambda a, v: a + v), F.size(logs)).alias("s")),
                       lambda v: v["x"] / v["s"])


def _plus(*arrays):
    out = arrays[0]
    for a in arrays[1:]:
        out = F.zip_with(out, a, lambda x, y: x + y)
    return out


def identify(pages: DataFrame, docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``page_id, lang, probability, text_lang, declared, host``, one row per page."""
    langs, model = train(docs, sample)
    k = len(langs)
    ev = text_evidence(pages, langs, model)
    if not k:
        return ev.select("page_id", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"),
                         F.lit(None).cast("string").alias("text_lang"), "declared", "host")
    ev = staged(ev.withColumn("post", _normal(F.col("ll"))), "evidence")
    total = staged(ev.agg(_sums(k).alias("all"), F.count(F.lit(1)).alias("n")), "total")      # one row
    first = total.first()
    whole = [float(x or 0.0) for x in first["all"]] if first["n"] else [0.0] * k
    n_all = max(1, first["n"])
    prior = [(x + SMOOTH) / (n_all + SMOOTH * k) for x in whole]

    def likelihood(col: str, out: str) -> DataFrame:
        """log P(value | language), smoothed by the value's overall share."""
        g = ev.groupBy(col).agg(_sums(k).alias("s"), F.count(F.lit(1)).alias("n"))
        share = F.col("n") / float(n_all)
        logs = [F.log((F.col("s")[i] + SMOOTH * share) / (whole[i] + SMOOTH)) for i in range(k)]
        return staged(g.select(col, F.array(*logs).alias(out)), out)

    domains = staged(ev.groupBy("domain").agg(_sums(k).alias("ds"), F.count(F.lit(1)).alias("dn")), "domains")
    hosts = staged(ev.groupBy("host", "domain").agg(_sums(k).alias("hs"), F.count(F.lit(1)).alias("hn"))
                   .join(domains, "domain").drop("domain"), "hosts")
    rows = (ev.join(hosts, "host", "left").join(likelihood("declared", "ld"), "declared", "left")
            .join(likelihood("suffix", "ls"), "suffix", "left"))
    logs = []
    for i in range(k):                                   # the page's own posterior is taken out of its host's sums
        domain = (F.col("ds")[i] - F.col("hs")[i] + DOMAIN_WEIGHT * prior[i]) / (F.col("dn") - F.col("hn") + DOMAIN_WEIGHT)
        host = (F.greatest(F.col("hs")[i] - F.col("post")[i], F.lit(0.0)) + HOST_WEIGHT * F.greatest(domain, F.lit(1e-9))) \
            / (F.col("hn") - 1 + HOST_WEIGHT)
        logs.append(F.log(host))
    rows = rows.withColumn("p", _normal(_plus(F.col("ll"), F.array(*logs), F.col("ld"), F.col("ls"))))
    names = F.array(*[F.lit(x) for x in langs])
    best = lambda c: F.element_at(names, F.array_position(c, F.array_max(c)).cast("int"))
    return rows.select("page_id", best(F.col("p")).alias("lang"), F.round(F.array_max("p"), 6).alias("probability"),
                       best(F.col("ll")).alias("text_lang"), "declared", "host")


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "pages"), documents(spark, sf_dir))
