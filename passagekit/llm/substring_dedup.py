"""Substring dedup by winnowed anchors and window digests.

A window is ``width`` consecutive words of one document. Each word covered by a
window whose word sequence also starts in a document with a smaller id is
removed; windows are judged on the input.

Seeds are winnowed anchors (:mod:`.anchors`); they choose the windows to compare.
Equal runs of windows on one anchor are matched whole (one digest). Where an
anchor has several different runs, documents are not joined on it and no match
is extended step by step: every window of each run's smallest holder is hashed
and grouped by its 128-bit digest over the corpus, so that a hot anchor makes no
pairs and its windows spread over the tasks. Put together, adjacent windows form
the maximal repeats of at least ``width`` words.

Defined results: a null text has no words; a null id counts as 2^63 - 1, the
largest id (such rows lose words to others, never to each other), and comes back
as null; rows repeated with
one id never remove each other's words; empty tables give empty results; extra
columns are ignored and may have any name. A pass holds about half a million
words whatever the length of a text.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import merge_spans
from .common import arrow_map, documents, staged
from .repeats import keyed, repeated_runs, slices, windows_of, with_spans

WIDTH = 50
ANCHOR_WORDS = 8


class _Words:
    """Word to a pair of 64-bit hashes, by a table kept between batches."""

    LIMIT = 1 << 19

    def __init__(self):
        self.index: dict[bytes, int] = {}
        self.hashes = np.zeros((2, 1 << 12), np.uint64)

    def ids(self, words: list[bytes]) -> np.ndarray:
        get = self.index.get
        found = [get(w) for w in words]
        for i in [i for i, x in enumerate(found) if x is None]:
            found[i] = self.add(words[i])
        return np.array(found, np.int64)

    def add(self, word: bytes) -> int:
        j = self.index.setdefault(word, len(self.index))
        if j == len(self.hashes[0]):
            self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)], axis=1)
        h = xxhash.xxh3_128_intdigest(word, 7)
        self.hashes[:, j] = h & 0xFFFFFFFFFFFFFFFF, h >> 64
        return j


def word_reader():
    table = _Words()

    def read(part):
        if len(table.index) > _Words.LIMIT:
            table.__init__()
        ids = [table.ids(t.split()) if t else np.zeros(0, np.int64)
               for t in part.column("text").cast("binary").to_pylist()]

        def symbols(i, a, b):
            w = ids[i][a:b]
            return table.hashes[0][w], table.hashes[1][w]

        return np.array([len(w) for w in ids]), symbols

    return read


def _read(part):
    """One reader per worker process."""
    global _READER
    if _READER is None:
        _READER = word_reader()
    return _READER(part)


_READER = None


def removed_spans(docs: DataFrame, width: int = WIDTH, k: int = ANCHOR_WORDS) -> DataFrame:
    """Word spans ``(did, th, b, e)`` covered by windows that also start in a
    document with a smaller id (spans may overlap)."""
    texts = keyed(docs)
    runs = repeated_runs(texts, _read, width, k)
    run = ["a", "f1", "f2"]
    groups = staged(runs.groupBy(run).agg(F.min("did").alias("first")), "groups")
    several = staged(groups.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a"), "several")
    held = staged(runs.join(groups, run), "held")
    whole = (held.where(F.col("did") > F.col("first"))
             .select("did", "th", F.col("s").alias("b"), (F.col("s") + F.col("c") + (width - 1)).alias("e")))
    # windows of the smallest holder of a run, against those of the anchor's other runs
    keys = held.where(F.col("did") == F.col("first")).join(several, "a", "left_semi").select("key")
    windows = staged(windows_of(texts, _read, width, k, keys), "windows")
    first = staged(windows.groupBy("w1", "w2").agg(F.min("did").alias("first"), F.max("did").alias("last"))
                   .where("first < last").select("w1", "w2", "first"), "first")
    extended = (windows.join(first, ["w1", "w2"]).where(F.col("did") > F.col("first"))
                .select("did", "th", F.col("s").alias("b"), (F.col("s") + width).alias("e")))
    return whole.unionByName(extended)


def dedup_substrings(docs: DataFrame, width: int = WIDTH, k: int = ANCHOR_WORDS) -> DataFrame:
    """``doc_id, text`` (kept words joined by one space), ``n_words, n_removed``
    and ``starts, ends`` (maximal removed word spans), one row per input row."""
    def cut(batches):
        for batch in batches:
            for part in slices(batch):
                out = {"doc_id": part.column("doc_id"), "text": [], "n_words": [], "n_removed": [],
                       "starts": [], "ends": []}
                for t, b, e in zip(part.column("text").cast("binary").to_pylist(),
                                   part.column("starts").to_pylist(), part.column("ends").to_pylist(), strict=True):
                    words = t.split() if t else []
                    n, gone, keep = len(words), 0, []
                    s, f = merge_spans(np.array(b or [], np.int64), np.array(e or [], np.int64))
                    last = 0
                    for x, y in zip(s.tolist(), f.tolist(), strict=True):
                        keep += words[last:x]
                        gone, last = gone + y - x, y
                    keep += words[last:]
                    out["text"].append(b" ".join(keep).decode("utf-8", "replace"))
                    out["n_words"].append(n)
                    out["n_removed"].append(gone)
                    out["starts"].append(s.tolist())
                    out["ends"].append(f.tolist())
                yield out

    rows = with_spans(docs, removed_spans(docs, width, k))
    return arrow_map(rows, cut, "doc_id long, text string, n_words long, n_removed long, "
                                "starts array<long>, ends array<long>")


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_substrings(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


# Windows as joined words; the smallest holder by window; covered words by position.
ORACLE = """
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 48, 1))) AS p FROM d),
h AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS h FROM s),
m AS (SELECT h, min(doc_id) AS first FROM h GROUP BY h),
bad AS (SELECT doc_id, p FROM h JOIN m USING (h) WHERE doc_id > first),
cover AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS p FROM bad),
gone AS (SELECT doc_id, list(p) AS ps FROM cover GROUP BY doc_id),
kept AS (
  SELECT d.doc_id, len(w) AS n_words, coalesce(len(ps), 0) AS n_removed,
         CASE WHEN ps IS NULL THEN w
              ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(ps, i)), lambda i: w[i]) END AS k
  FROM d LEFT JOIN gone USING (doc_id))
SELECT doc_id, n_words, n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
"""
