"""Ops 1 and 9 against brute force over odd texts; the suffix sorter by itself."""

import hashlib

import numpy as np
import pytest

from passagekit.llm import substring_dedup, suffix_dedup
from passagekit.llm.induced import suffix_order

LAST = (1 << 63) - 1


def brute_bytes(rows, width):
    texts = [(t or "").encode() for _, t in rows]
    seen = {}
    for t in texts:
        for p in range(len(t) - width + 1):
            seen[t[p:p + width]] = seen.get(t[p:p + width], 0) + 1
    out = []
    for (d, _), t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - width + 1):
            if seen[t[p:p + width]] > 1:
                gone[p:p + width] = True
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((d, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def brute_words(rows, width):
    ws = [(LAST if d is None else d, (t or "").encode().split()) for d, t in rows]
    first = {}
    for d, w in ws:
        for p in range(len(w) - width + 1):
            k = tuple(w[p:p + width])
            first[k] = min(first.get(k, LAST), d)
    out = []
    for (d, _), (i, w) in zip(rows, ws, strict=True):
        gone = [False] * len(w)
        for p in range(len(w) - width + 1):
            if first[tuple(w[p:p + width])] < i:
                gone[p:p + width] = [True] * width
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def key(row):
    return tuple((x is None, x or 0) for x in row)


@pytest.mark.parametrize("contexts", [512, 1])
def test_byte_dedup_equals_brute_force(spark, wide, contexts):
    from pyspark.sql import functions as F
    rows = [(r.doc_id, r.text) for r in wide.collect()]
    out = suffix_dedup.dedup_bytes(wide, contexts=contexts, shard_bytes=3000, memory=64)
    out = out.select("doc_id", "n_bytes", "n_removed", F.size("starts"), F.sha2("kept", 256))
    assert sorted(map(tuple, out.collect()), key=key) == sorted(brute_bytes(rows, 200), key=key)


def test_full_bitmap_brings_no_copies_to_a_shard(spark, monkeypatch):
    """Every bit set, one passage in very many documents: the shards still get
    one row per distinct run."""
    import random

    from passagekit.llm import common
    rng = random.Random(9)
    say = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    passage, other = say(900), say(900)
    rows = [(i, say(40) + passage + say(40)) for i in range(60)] + [(100 + i, passage) for i in range(60)]
    rows += [(200 + i, other[:i * 10] + say(3) + other[i * 10:]) for i in range(20)] + [((1 << 63) - 1, passage), (None, passage)]
    monkeypatch.setattr(common, "FILTER_BITS", 4096 * 8)
    monkeypatch.setattr(common, "MAX_FILTER_BITS", 4096 * 8)
    monkeypatch.setattr(common, "has_bits", lambda bitmap, keys: np.ones(len(keys), bool))
    for m in (suffix_dedup, __import__("passagekit.llm.repeats", fromlist=["x"])):
        monkeypatch.setattr(m, "has_bits", lambda bitmap, keys: np.ones(len(keys), bool))
    sorted_rows, reps, own_map, own_stage = [], [], suffix_dedup.arrow_map, suffix_dedup.staged

    def arrow_map(df, fn, schema):
        if "text" in df.columns and "unit" in df.columns:
            sorted_rows.append(df.count())
        return own_map(df, fn, schema)

    def staged(df, name):
        out = own_stage(df, name)
        if name == "reps":
            reps.append(out.count())
        return out

    monkeypatch.setattr(suffix_dedup, "arrow_map", arrow_map)
    monkeypatch.setattr(suffix_dedup, "staged", staged)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = suffix_dedup.dedup_bytes(docs)
    from pyspark.sql import functions as F
    out = out.select("doc_id", "n_bytes", "n_removed", F.size("starts"), F.sha2("kept", 256))
    assert sorted(map(tuple, out.collect()), key=key) == sorted(brute_bytes(rows, 200), key=key)
    assert sorted_rows == reps and reps[0] < 1200


def test_windows_too_wide_for_the_digests_are_refused():
    from passagekit.llm.anchors import Runs
    h = np.arange(5000, dtype=np.uint64)
    with pytest.raises(ValueError):
        Runs(h, h, [5000], 1024, 96)


def test_word_dedup_equals_brute_force(spark, wide):
    from pyspark.sql import functions as F
    rows = [(r.doc_id, r.text) for r in wide.collect()]
    out = substring_dedup.dedup_substrings(wide).select("doc_id", "n_words", "n_removed", F.sha2("text", 256))
    assert sorted(map(tuple, out.collect()), key=key) == sorted(brute_words(rows, 50), key=key)


def test_long_text_is_cut_into_overlapping_pieces(spark, monkeypatch):
    from passagekit.llm import anchors
    lengths = [10, 5000, 200, 199, 0]
    monkeypatch.setattr(anchors, "CHUNK", 1000)
    starts = sorted((i, p) for part in anchors.chunks(lengths, 200) for i, a, b in part for p in range(a, b - 199))
    assert starts == [(i, p) for i, n in enumerate(lengths) for p in range(max(0, n - 199))]


def test_empty_tables(spark, empty):
    assert suffix_dedup.dedup_bytes(empty).collect() == []
    assert substring_dedup.dedup_substrings(empty).collect() == []


def test_suffix_order_with_tiny_memory(tmp_path):
    rng = np.random.default_rng(1)
    for t in range(300):
        x = rng.integers(0, rng.integers(1, 5), rng.integers(0, 60))
        k = 5
        if t % 3 == 0:
            x, k = x * 97, 700                      # visited in batches of symbols
        if t % 7 == 0:
            x = np.tile(x[:3], 9)
        got = suffix_order(x, k, str(tmp_path), memory=int(rng.integers(1, 40)))
        assert got.tolist() == sorted(range(len(x)), key=lambda i: x[i:].tolist())
