"""Quality rules: a learned decision list over text statistics.

Rules for the class to reject are learned by sequential covering: a rule (a
conjunction of thresholds on statistics) is grown on two thirds of the labelled
sample by information gain, pruned on the rest, and kept while its precision
there is high enough; the rows it covers are then set aside and the next rule
is learned. The list becomes one ordered Spark conditional expression.

The sample is bounded: at most ``sample`` labelled documents, taken in the order
of a hash of their id. Statistics and verdicts cover all documents.

Defined results: a null text has no words, so its base rule fails and it is not
kept; null or conflicting labels count as the lower quality present (null
labels are ignored); without labels the list is empty and only the base rule
rejects; repeated rows are judged alike; extra columns pass through.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import SPACES, documents, in_sample, table

SAMPLE = 20_000
MIN_PRECISION = 0.9
MAX_RULES, MAX_CONDITIONS = 24, 4
WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
STATS = BASE + ["n_lines", "n_distinct", "n_sentence_ends", "n_short", "n_long"]
_STATS_TYPE = ", ".join(f"{c} long" for c in STATS)
_SYMBOLS = b"#*$%&|<>"


def repeat_words(ids: np.ndarray, width: int = WINDOW) -> int:
    """Words in windows of ``width`` symbols found twice or more."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    name, size, have = ids, int(ids.max()) + 1, 1
    while have < width:                           # names of longer and longer windows, by doubling
        step = min(have, width - have)
        pair = name[:len(name) - step] * np.int64(size) + name[step:]
        _, name = np.unique(pair, return_inverse=True)
        size, have = int(name.max()) + 1, have + step
    twice = np.bincount(name)[name] > 1
    cover = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + width, -1)
    return int((np.cumsum(cover) > 0).sum())


def text_stats(text: bytes) -> tuple[int, ...]:
    """The statistics of one UTF-8 text, in the order of ``STATS``."""
    words = text.split()
    n = len(words)
    if not n:
        return (0, 0, len(text) - len(text.translate(None, _SYMBOLS)), *[0] * (len(STATS) - 3))
    letters = text.translate(None, SPACES)
    continued = 0 if letters.isascii() else len(letters) - len(letters.translate(None, _CONTINUATION))
    lines = [x for x in text.split(b"\n") if x.strip()]
    index: dict[bytes, int] = {}
    ids = np.array([index.setdefault(w, len(index)) for w in words], np.int64)
    repeated = repeat_words(ids) if len(index) < n else 0
    sizes = np.fromiter(map(len, words), np.int64, n)
    ends = sum(w.endswith((b".", b"!", b"?")) for w in words)
    return (n, len(letters) - continued, len(text) - len(text.translate(None, _SYMBOLS)), len(lines) - len(set(lines)),
            repeated, len(lines), len(index), int(ends), int((sizes <= 2).sum()), int((sizes > 12).sum()))


_CONTINUATION = bytes(range(0x80, 0xC0))          # UTF-8 bytes that start no code point


def with_stats(docs: DataFrame, out: str) -> DataFrame:
    """``docs`` with a struct column ``out`` of the statistics of ``text``."""
    ship_package(docs.sparkSession)

    @F.pandas_udf(_STATS_TYPE)
    def stats(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([text_stats(t.encode()) if t is not None else text_stats(b"") for t in text],
                            columns=STATS, dtype="int64")

    return docs.withColumn(out, stats(F.col("text")))


def base_failed(s: Column) -> Column:
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEAT_PERCENT * s["n_words"])


# Rates the learner may test; each is a plain expression of the statistics.
FEATURES = {
    "n_words": lambda s: s["n_words"],
    "word_length": lambda s: s["word_chars"] / (s["n_words"] + 1),
    "symbol_rate": lambda s: s["n_symbols"] / (s["n_words"] + 1),
    "dup_line_rate": lambda s: s["n_dup_lines"] / (s["n_lines"] + 1),
    "repeat_rate": lambda s: s["n_repeat_words"] / (s["n_words"] + 1),
    "line_words": lambda s: s["n_words"] / (s["n_lines"] + 1),
    "distinct_rate": lambda s: s["n_distinct"] / (s["n_words"] + 1),
    "sentence_rate": lambda s: s["n_sentence_ends"] / (s["n_words"] + 1),
    "short_rate": lambda s: s["n_short"] / (s["n_words"] + 1),
    "long_rate": lambda s: s["n_long"] / (s["n_words"] + 1),
}
Condition = tuple[str, str, float]


def covers(x: dict[str, np.ndarray], rule: list[Condition]) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), bool)
    for f, op, v in rule:
        out &= x[f] >= v if op == ">=" else x[f] <= v
    return out


def _best_condition(x, y):
    """The threshold with the highest FOIL gain among rows (x, y: bool target)."""
    p0, n0 = int(y.sum()), int((~y).sum())
    start = np.log2(p0 / (p0 + n0))
    best = (0.0, None)
    for f, v in x.items():
        order = np.argsort(v, kind="stable")
        s, t = v[order], y[order]
        edge = np.flatnonzero(s[1:] > s[:-1])
        if not len(edge):
            continue
        p_low, n_low = np.cumsum(t)[edge], np.cumsum(~t)[edge]
        mid = (s[edge] + s[edge + 1]) / 2
        for op, p, n in (("<=", p_low, n_low), (">=", p0 - p_low, n0 - n_low)):
            gain = p * (np.log2(np.maximum(p, 1e-9) / (p + n)) - start)
            i = int(np.argmax(gain))
            if gain[i] > best[0] + 1e-9:
                best = (float(gain[i]), (f, op, float(mid[i])))
    return best[1]


def learn_rules(x: dict[str, np.ndarray], reject: np.ndarray, seed: int = 0,
                min_precision: float = MIN_PRECISION) -> list[list[Condition]]:
    """Ordered rules for the rows to reject."""
    rules: list[list[Condition]] = []
    rng = np.random.default_rng(seed)
    live = np.ones(len(reject), bool)
    while len(rules) < MAX_RULES and reject[live].sum() >= 3:
        at = rng.permutation(np.flatnonzero(live))
        grow, prune = at[:2 * len(at) // 3], at[2 * len(at) // 3:]
        rule, rows = [], grow
        while len(rule) < MAX_CONDITIONS and reject[rows].any() and not reject[rows].all():
            c = _best_condition({f: v[rows] for f, v in x.items()}, reject[rows])
            if c is None:
                break
            rule.append(c)
            rows = rows[covers({c[0]: x[c[0]][rows]}, [c])]
        if not rule:
            break

        def worth(r):
            hit = covers({f: v[prune] for f, v in x.items()}, r)
            p = int(reject[prune][hit].sum())
            return (2 * p - hit.sum()) / max(1, hit.sum()), p, int(hit.sum())

        cuts = [rule[:i] for i in range(1, len(rule) + 1)]
        rule = max(cuts, key=lambda r: (worth(r)[0], -len(r)))
        _, p, hit = worth(rule)
        if not hit or p / hit < min_precision:
            break
        rules.append(rule)
        live &= ~covers(x, rule)
    return rules


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """Features and target (True: reject) of at most ``sample`` labelled documents."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    picked = (usable.where(in_sample(usable, "doc_id", sample)).groupBy("doc_id").agg(F.min("quality").alias("q"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    rows = with_stats(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id"), "s")
    rows = rows.select("doc_id", "q", *[f(F.col("s")).cast("double").alias(n) for n, f in FEATURES.items()])
    # where an id repeats with different texts, the one with the smallest statistics trains
    first = F.min(F.struct("q", *FEATURES)).alias("r")
    got = rows.groupBy("doc_id").agg(first).orderBy("doc_id").select("doc_id", "r.*").toPandas()
    return {f: got[f].to_numpy(float) for f in FEATURES}, (got["q"] == 0).to_numpy(bool)


def verdict(rules: list[list[Condition]], s: Column) -> Column:
    """True where no rule of the list matches, as one ordered conditional."""
    out = None
    for rule in rules:
        cond = F.lit(True)
        for f, op, v in rule:
            x = FEATURES[f](s)
            cond = cond & (x >= v if op == ">=" else x <= v)
        out = F.when(cond, F.lit(False)) if out is None else out.when(cond, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def judge(docs: DataFrame, labels: DataFrame, out: str = "quality_verdict") -> DataFrame:
    """``docs`` with a struct ``out``: the statistics, ``base_failed`` and ``kept``."""
    rules = learn_rules(*training_rows(docs, labels))
    s = F.col(out)
    ok = ~base_failed(s) & verdict(rules, s)
    return with_stats(docs, out).withColumn(out, s.withField("base_failed", base_failed(s)).withField("kept", ok))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that the rules reject."""
    name = "_".join(["verdict", *docs.columns])[:200]        # no clash with any column
    return judge(docs, labels, name).where(F.col(name)["kept"]).select(*docs.columns)


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    out = judge(documents(spark, sf_dir), table(spark, sf_dir, "labels"), "s")
    return out.select("doc_id", *[F.col(f"s.{c}").alias(c) for c in [*STATS, "base_failed", "kept"]])
