import random

from passagekit.llm import decontamination as d


def edits(a, b):
    """Smallest edit distance of a to any region of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def case(n_docs=60, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(60)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, say(rng.randint(9, 40))) for i in range(12)] + [(99, "tiny"), (98, None), (97, "")]
    docs = [(0, None), (1, ""), (2, " ")]
    for i in range(3, n_docs):
        t = say(rng.randint(0, 60))
        if i % 2:
            x = list(items[i % 12][1])
            for _ in range(rng.randint(0, len(x) // 12)):
                p = rng.randrange(len(x))
                x[p:p + 1] = rng.choice([[], ["z"], [x[p], "q"]])
            t = t + " " + "".join(x).upper().replace(" ", "\n ") + " " + say(10)
        docs.append((i, t))
    return docs, items


def want(docs, items):
    out = set()
    for i, t in docs:
        for k, x in items:
            n = d.normalise(x)
            budget = min(int(d.EDIT_RATE * len(n)), len(n) // d.Q - 1) if len(n) >= d.MIN_EDITED else 0
            if n and (edits(n, d.normalise(t)) <= budget if len(n) >= d.Q else d.normalise(t) == n):
                out.add((i, k))
    return out


def test_leaks_equal_brute_force(spark, monkeypatch):
    docs, items = case()
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = d.find_leaks(frame, bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want(docs, items)
    text = dict(docs)
    for r in found:
        assert edits(d.normalise(dict(items)[r.item_id]), d.normalise(text[r.doc_id])[r.begin:r.end]) == r.edits
    monkeypatch.setattr(d, "BLOCK_CHARS", 500)                    # several blocks: the same leaks
    monkeypatch.setattr(d, "_PIECE", 64)
    assert {(r.doc_id, r.item_id) for r in d.find_leaks(frame, bench).collect()} == want(docs, items)
    kept = d.drop_leaks(frame, bench)
    assert kept.columns == frame.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in docs} - {i for i, _ in want(docs, items)}


def test_short_items_repeated_rows_and_ids(spark):
    items = [(1, "Exactly  this Line"), (2, "yes"), (3, "no"), (4, "x" * 39), (5, "Exactly this line"), (5, "yes")]
    docs = [(1, "before EXACTLY this line\nafter"), (2, "exactly this lime"), (3, "Yes "), (4, "yes, but more"), (5, "no\n"), (6, "x" * 38 + "y"),
            (7, "a " + "x" * 39), (7, "clean"), (7, "a " + "x" * 39), (None, "NO")]
    frame = spark.createDataFrame([(*r, 0, "b") for r in docs], "doc_id long, text string, begin int, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = [(r.doc_id, r.item_id, r.edits) for r in d.find_leaks(frame, bench).collect()]
    want_ = [(1, 1, 0), (1, 5, 0), (3, 2, 0), (3, 5, 0), (5, 3, 0), (7, 4, 0), (7, 4, 0), (None, 3, 0)]
    assert sorted(found, key=str) == sorted(want_, key=str)
    kept = d.drop_leaks(frame, bench)
    assert kept.columns == frame.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(2, docs[1][1]), (4, docs[3][1]), (6, docs[5][1]), (7, "clean")]


def test_empty(spark, empty):
    bench = spark.createDataFrame([(1, "a" * 50)], "item_id long, text string")
    assert d.find_leaks(empty, bench).collect() == []
    assert d.drop_leaks(empty, bench).collect() == []
    assert d.find_leaks(empty, bench.where("false")).columns == ["doc_id", "item_id", "begin", "end", "edits"]
