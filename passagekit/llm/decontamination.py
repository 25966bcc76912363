"""Benchmark decontamination by q-gram lemma filtering.

Texts and benchmark items are lower-cased with white space collapsed. An item
of m characters leaks into a text if some region of the text is within
``e = floor(rate * m)`` edits of the whole item. By the q-gram lemma such a
region shares at least ``m + 1 - q * (e + 1)`` character q-grams with the item,
and their diagonals (text position minus item position) differ by at most
``e``. So shared q-grams are counted in diagonal bands of width ``2 * (e + 1)``
that overlap by half; bands that reach the bound are verified by a banded
alignment with free ends in the text.

The benchmark is the stated query set: it is read in blocks of bounded size,
each broadcast to one map-only pass over the texts; no text is ever shuffled.
With several blocks each one's result is written before the next block is read,
so one index is held at a time.

Items shorter than ``MIN_EDITED`` normalised characters are matched unchanged
(edit budget 0); those shorter than a q-gram, which any text may hold by chance,
match a text that consists of them alone.

Defined results: null and empty texts and items match nothing; repeated rows are judged alike; repeated
items each report; extra columns pass through. Long texts are counted in pieces
and aligned region by region.
"""

from __future__ import annotations

import bisect
import functools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .anchors import M1, M2, Digest
from .common import arrow_map, documents, staged, table
from .repeats import SLICE_BYTES, slices

Q = 12
EDIT_RATE = 0.05
MIN_EDITED = 40               # items below are matched unchanged
BLOCK_CHARS = 2_000_000      # benchmark characters broadcast at once
_TABLE_BITS = 22
_PIECE = 1 << 18             # text characters counted at once


def normalise(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def text_slices(texts):
    """Runs of consecutive texts of bounded size."""
    out, size = [], 0
    for t in texts:
        if out and size + len(t or "") > SLICE_BYTES:
            yield out
            out, size = [], 0
        out.append(t)
        size += len(t or "")
    if out:
        yield out


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def grams(c: np.ndarray) -> np.ndarray:
    """Hash of the q-gram at every position (the high bits are well spread)."""
    n = len(c) - Q + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    h = Digest(c.astype(np.uint64), M1, max(len(c) + 1, _PIECE + 4096))
    g = h.p[Q:] - h.p[:-Q]
    g *= h.down[:n]
    g ^= g >> np.uint64(29)
    g *= np.uint64(M2)
    return g


class Index:
    """Q-grams of one block of benchmark items: ``[(item id, text), ...]``."""

    def __init__(self, items: list[tuple[int, str]], rate: float = EDIT_RATE):
        items = [(i, n) for i, t in items if (n := normalise(t))]
        self.whole: dict[str, list[int]] = {}                  # items shorter than a q-gram
        for i, n in items:
            if len(n) < Q:
                self.whole.setdefault(n, []).append(i)
        items = [(i, n) for i, n in items if len(n) >= Q]
        self.ids = [i for i, _ in items]
        self.items = [codes(t) for _, t in items]
        self.edits = np.array([min(int(rate * len(c)), len(c) // Q - 1) if len(c) >= MIN_EDITED else 0 for c in self.items], np.int64)
        self.least = np.array([len(c) + 1 - Q * (e + 1) for c, e in zip(self.items, self.edits, strict=True)], np.int64)
        g = [grams(c) for c in self.items]
        every = np.concatenate([*g, np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(len(g)), [len(x) for x in g]).astype(np.int64)
        pos = np.concatenate([*[np.arange(len(x)) for x in g], np.zeros(0, np.int64)])
        order = np.argsort(every, kind="stable")
        self.item, self.pos = item[order], pos[order]
        self.values, self.first, self.count = np.unique(every[order], return_index=True, return_counts=True)
        self.maybe = np.zeros(1 << _TABLE_BITS, bool)
        self.maybe[(self.values >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True

    def hits(self, c: np.ndarray):
        """``(text position, item, item position)`` of every shared q-gram."""
        g = grams(c)
        at = np.flatnonzero(self.maybe[(g >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)])
        j = np.searchsorted(self.values, g[at])
        j[j == len(self.values)] = 0
        ok = self.values[j] == g[at] if len(self.values) else np.zeros(len(at), bool)
        at, j = at[ok], j[ok]
        n = self.count[j]
        which = np.repeat(np.arange(len(at)), n)
        entry = self.first[j][which] + (np.arange(len(which)) - (np.cumsum(n) - n)[which])
        return at[which], self.item[entry], self.pos[entry]

    def bands(self, c: np.ndarray) -> list[tuple[int, int]]:
        """Bands ``(item, lowest diagonal)`` of a text that reach the bound."""
        if not len(self.ids):
            return []
        keys, counts = [], []
        for a in range(0, max(1, len(c) - Q + 1), _PIECE):
            at, item, pos = self.hits(c[a:a + _PIECE + Q - 1])
            band = (at + a - pos) // (self.edits[item] + 1)    # band b holds the steps b and b + 1
            key = (item << 40) + band + (1 << 39)
            k, n = np.unique(np.concatenate([key, key - 1]), return_counts=True)
            keys.append(k)
            counts.append(n)
        if len(keys) > 1:
            k, back = np.unique(np.concatenate(keys), return_inverse=True)
            n = np.bincount(back, np.concatenate(counts), len(k))
        item = k >> 40
        ok = n >= self.least[item]
        item, k = item[ok], k[ok]
        low = ((k & ((1 << 40) - 1)) - (1 << 39)) * (self.edits[item] + 1)
        return list(zip(item.tolist(), low.tolist(), strict=True))

    def matches(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
        """Leaks in a list of texts: ``(position in the list, item id, begin,
        end, edits)``, one per item and place (overlapping ones: the fewest
        edits). The texts are counted as one, then aligned one by one."""
        texts = [normalise(t) for t in texts]
        ends = np.cumsum([len(t) + 1 for t in texts])
        found, cache = [], {}
        for item, low in self.bands(codes("\n".join(texts))):     # no normalised text holds a line feed
            e, m = int(self.edits[item]), len(self.items[item])
            first = int(np.searchsorted(ends, max(0, low - e), side="right"))
            last = int(np.searchsorted(ends, low + 3 * e + 1 + m, side="right"))
            for i in range(first, min(last, len(texts) - 1) + 1):
                start = int(ends[i]) - len(texts[i]) - 1
                if i not in cache:
                    cache = {i: codes(texts[i])}
                hit = align(self.items[item], cache[i], low - start, low - start + 2 * (e + 1) - 1, e)
                if hit:
                    found.append((i, item, *hit))
        out, begins, ends_, place = [], [], [], None
        for row in sorted(found, key=lambda x: (x[0], x[1], x[4], x[2])):
            if row[:2] != place:
                begins, ends_, place = [], [], row[:2]
            at = bisect.bisect_left(begins, row[2])               # chosen places are disjoint and in order
            if (at == 0 or ends_[at - 1] <= row[2]) and (at == len(begins) or row[3] <= begins[at]):
                begins.insert(at, row[2])
                ends_.insert(at, row[3])
                out.append(row)
        out = [(i, self.ids[item], b, f, d) for i, item, b, f, d in sorted(out, key=lambda x: (x[0], x[2], x[1]))]
        if self.whole:
            out += [(i, item, 0, len(t), 0) for i, t in enumerate(texts) for item in self.whole.get(t, [])]
        return out


def align(item: np.ndarray, text: np.ndarray, low: int, high: int, e: int):
    """Best region of ``text`` for ``item`` with start diagonals in the band
    ``low..high`` widened by ``e``: ``(begin, end, edits)`` if within ``e``
    edits. Only cells of the band are computed."""
    low, high, m, n = low - e, high + e, len(item), len(text)
    for s in range(low, high + 1):                             # an unchanged copy needs no alignment
        if 0 <= s <= n - m and text[s] == item[0] and np.array_equal(text[s:s + m], item):
            return s, s + m, 0
    w = high - low + 1
    big = m + w + n + 1
    diag = np.arange(low, high + 1)                            # cell j stands at text position i + diag[j]
    cost = np.where((diag >= 0) & (diag <= n), 0, big)
    begin = diag.copy()
    step = np.arange(w)
    for i in range(1, m + 1):
        at = diag + i                                          # text characters consumed
        inside = (at >= 1) & (at <= n)
        same = np.zeros(w, bool)
        same[inside] = text[at[inside] - 1] == item[i - 1]
        new = np.where(inside, cost + ~same, big)
        frm = begin
        up, upb = np.r_[cost[1:], big] + 1, np.r_[begin[1:], 0]    # item character left out
        ok = (up < new) & (at >= 0) & (at <= n)
        new, frm = np.where(ok, up, new), np.where(ok, upb, frm)
        run = new - step                                       # text characters left out
        best = np.minimum.accumulate(run)
        src = np.maximum.accumulate(np.where(run == best, step, 0))
        better = best + step < new
        new, frm = np.where(better & inside, best + step, new), np.where(better & inside, frm[src], frm)
        cost, begin = new, frm
        if cost.min() > e:
            return None
    j = int(np.argmin(cost))
    return (int(begin[j]), int(diag[j] + m), int(cost[j])) if cost[j] <= e else None


def blocks(benchmark: DataFrame) -> list[DataFrame]:
    """The benchmark in hash blocks of about ``BLOCK_CHARS`` characters."""
    b = benchmark.where(F.length("text") > 0).select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = b.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    n = -(-size // BLOCK_CHARS)
    return [b.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) for i in range(n)]


def _index(block: DataFrame, rate: float):
    rows = block.orderBy("item_id", "text").collect()
    ship_package(block.sparkSession)
    return block.sparkSession.sparkContext.broadcast(Index([(r[0], r[1]) for r in rows], rate))


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = EDIT_RATE) -> DataFrame:
    """``doc_id, item_id, begin, end, edits``: one row per leaked region, with
    places in the normalised text."""
    schema = "doc_id long, item_id long, begin long, end long, edits long"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found, own = [], blocks(benchmark)
    several = len(own) > 1
    for block in own:
        index = _index(block, rate)

        def run(batches, index=index):
            for batch in batches:
                for part in slices(batch):
                    ids = part.column("doc_id").to_pylist()
                    rows = [(ids[i], *m) for i, *m in index.value.matches(part.column("text").to_pylist())]
                    if rows:
                        yield dict(zip(("doc_id", "item_id", "begin", "end", "edits"),
                                       map(list, zip(*rows, strict=True)), strict=True))

        found.append(_settled(arrow_map(texts, run, schema), index, several, "leaks"))
    if not found:
        return texts.where(F.lit(False)).selectExpr("doc_id", *[f"CAST(NULL AS BIGINT) AS {c}" for c in
                                                               ("item_id", "begin", "end", "edits")])
    return functools.reduce(DataFrame.unionByName, found)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = EDIT_RATE) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item."""
    own = blocks(benchmark)
    for block in own:
        index = _index(block, rate)
        docs = _settled(docs.where(~_leaks(index)(F.col("text"))), index, len(own) > 1, "clean")
    return docs


def _settled(df: DataFrame, index, several: bool, name: str) -> DataFrame:
    """``df``, written if another block's index comes after this one's."""
    if not several:
        return df
    out = staged(df, name)
    index.destroy()
    return out


def _leaks(index):
    @F.pandas_udf("boolean")
    def leaks(text: pd.Series) -> pd.Series:
        out, at = np.zeros(len(text), bool), 0
        for part in text_slices(text):
            out[[at + m[0] for m in index.value.matches(part)]] = True
            at += len(part)
        return pd.Series(out)

    return leaks


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    return find_leaks(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
