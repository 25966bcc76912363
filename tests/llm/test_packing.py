import bisect
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from passagekit.llm import packing as P


def best_fit(items, capacity):
    """Bins of best fit, longest first, one item at a time."""
    rooms, bins = [], 0
    for s in sorted(items, reverse=True):
        at = bisect.bisect_left(rooms, s)
        room = rooms.pop(at) if at < len(rooms) else capacity
        bins += room == capacity
        if room > s:
            bisect.insort(rooms, room - s)
    return bins


def laid_out(bins, offsets, lengths, capacity):
    """Number of bins, after checking that each is gapless from 0 and not overfull."""
    rows = sorted(zip(bins, offsets, lengths))
    end = {}
    for b, o, n in rows:
        assert o == end.get(b, 0)
        end[b] = o + n
    assert max(end.values()) <= capacity
    return len(end)


@pytest.mark.parametrize("seed", range(60))
def test_plan_is_best_fit(seed):
    rng = random.Random(seed)
    cap = rng.choice([5, 10, 30, 100, 2048])
    counts = {s: rng.randint(1, rng.choice([2, 50])) for s in rng.sample(range(1, cap + 1), rng.randint(1, min(cap, 60)))}
    length = np.concatenate([np.full(n, s) for s, n in counts.items()])
    rank = np.concatenate([np.arange(n) for n in counts.values()])
    bins, offsets = P.places(P.plan(counts, cap), length, rank)
    assert laid_out(bins.tolist(), offsets.tolist(), length.tolist(), cap) == best_fit(length.tolist(), cap)


def test_plan_does_not_grow_with_the_rows():
    rng = random.Random(1)
    small = {s: rng.randint(1, 100) for s in range(1, 2049)}
    large = {s: n * 10 ** 10 + rng.randint(0, 10 ** 9) for s, n in small.items()}
    assert len(P.plan(large)) < 10_000
    assert P.plan({}).shape == (0, 5)


def pairs_of(items, capacity):
    """Fewest bins of items above a third, by trying all matchings."""
    if not items:
        return 0
    a, rest = items[0], items[1:]
    return min([1 + pairs_of(rest, capacity)]
               + [1 + pairs_of(rest[:k] + rest[k + 1:], capacity) for k, b in enumerate(rest) if a + b <= capacity])


@pytest.mark.parametrize("seed", range(20))
def test_large_items_are_matched_best(seed):
    rng = random.Random(seed)
    items = [rng.randint(11, 30) for _ in range(8)]
    counts = {s: items.count(s) for s in set(items)}
    steps = P.plan(counts, 30)
    bins, _ = P.places(steps, np.array(sorted(items)), np.array([sorted(items)[:k].count(s) for k, s in enumerate(sorted(items))]))
    assert len(set(bins.tolist())) == pairs_of(items, 30)


TOK = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
TOK.encode_special_tokens = True


def ids_of(text):
    return TOK.encode(text or "", add_special_tokens=False).ids + [0]


@pytest.mark.parametrize("frame", ["docs", "wide"])
def test_pieces_and_sequences_give_the_texts_back(request, frame):
    docs = request.getfixturevalue(frame)
    placed = P.packed(docs, capacity=64).persist()
    rows = placed.collect()
    laid_out([r.sequence_id for r in rows], [r.offset for r in rows], [r.length for r in rows], 64)
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    want = []
    for d, t in texts:
        ids = ids_of(t)
        first = (len(ids) - 1) % 64 + 1
        cuts = [0, *range(first, len(ids) + 1, 64)]
        want += [(d, k, lo, hi - lo, zlib.crc32(np.array(ids[lo:hi], "<u4").tobytes()), ids[lo:hi])
                 for k, (lo, hi) in enumerate(zip(cuts, cuts[1:]))]
    got = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32, list(r.ids)) for r in rows]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(got, key=key) == sorted(want, key=key)
    # the sequences themselves
    whole = {r.sequence_id: list(r.ids) for r in P.sequences(placed).collect()}
    assert all(whole[r.sequence_id][r.offset:r.offset + r.length] == list(r.ids) for r in rows)
    assert sum(map(len, whole.values())) == sum(r.length for r in rows)
    assert len(whole) == best_fit([r.length for r in rows], 64)


def test_odd_texts_have_the_tokenizers_ids():
    rng = random.Random(3)
    encode = P.encoder(P.TOKENIZER)
    parts = ["a", "b", " ", " ", "\n", "'s", "1", ".", "é", "\x1c", "日", "<|endoftext|>", "\u0085", " ", "\U0001f600", "word "]
    for text in ["", " ", "<|endoftext|> a", *("".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(2000)), "x" * 5000]:
        assert list(encode(text)) + [0] == ids_of(text)


def test_ranks_run_over_all_parts(spark, docs):
    many = docs.repartition(5)
    rows = P.packed(many, capacity=64, with_ids=False).collect()
    assert laid_out([r.sequence_id for r in rows], [r.offset for r in rows], [r.length for r in rows], 64) == best_fit([r.length for r in rows], 64)
    assert all(r.ids is None for r in rows)


def test_empty(empty):
    got = P.packed(empty)
    assert got.count() == 0 and got.columns[-2:] == ["sequence_id", "offset"]
    assert P.packed(empty.withColumn("sequence_id", F.lit("clash"))).count() == 0
