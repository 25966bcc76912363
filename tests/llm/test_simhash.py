import random

import numpy as np
import xxhash

from passagekit.llm import simhash
from passagekit.llm.common import connected_components


def brute_print(text):
    w = (text or "").encode().lower().split()
    g = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in g]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(rows, prints, radius=3):
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                up[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return [low.get(find(i)) for i in range(len(rows))]


def test_groups_equal_brute_force(spark, wide):
    rows = [(r.doc_id, r.text) for r in wide.collect()]
    prints = [brute_print(t) for _, t in rows]
    want = sorted(zip([d for d, _ in rows], prints, brute_groups(rows, prints), strict=True), key=str)
    got = [(r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.simhash_groups(wide).collect()]
    assert sorted(got, key=str) == want


def test_links_of_dense_and_chained_fingerprints(spark):
    """Random centres, dense balls around some and a chain; trees of 16 nodes."""
    rng = random.Random(3)
    points = {rng.getrandbits(64) for _ in range(300)}
    centre = rng.getrandbits(64)
    for _ in range(250):
        points.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))))
    chain = rng.getrandbits(64)
    for i in range(0, 60, 3):
        chain ^= 7 << i
        points.add(chain)
    points = sorted(points)
    up = list(range(len(points)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i
    for i in range(len(points)):
        for j in range(i):
            if (points[i] ^ points[j]).bit_count() <= 3:
                up[find(i)] = find(j)
    want = {}
    for i in range(len(points)):
        want.setdefault(find(i), set()).add(points[i])
    nodes = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in points], "fp long")
    edges = simhash.links(nodes, 3, tree=16)
    got = {}
    for r in connected_components(edges, "a", "b").collect():
        got.setdefault(r.root, set()).add(r.node % (1 << 64))
    assert sorted(map(sorted, got.values())) == sorted(sorted(s) for s in want.values() if len(s) > 1)


def test_tree_finds_every_neighbour():
    rng = np.random.default_rng(2)
    points = np.unique(rng.integers(0, 1 << 12, 200, dtype=np.uint64))
    queries = rng.integers(0, 1 << 12, 50, dtype=np.uint64)
    found = {(n, int(q)) for n, near in simhash.BKTree(points).search(queries, 2) for q in near}
    assert found == {(i, j) for i, p in enumerate(points) for j, q in enumerate(queries)
                     if int(p ^ q).bit_count() <= 2}


def test_one_document_of_each_group_stays(spark, wide, empty):
    rows = [(r.doc_id, r.text) for r in wide.collect()]
    kept = simhash.keep_one(wide)
    assert kept.columns == wide.columns
    groups = brute_groups(rows, [brute_print(t) for _, t in rows])
    ids = sorted({d for (d, _), c in zip(rows, groups, strict=True) if d is not None and d == c})
    got = [r.doc_id for r in kept.collect()]
    assert sorted(d for d in got if d is not None) == ids
    assert got.count(None) == 0                  # both rows without an id copy others that have one
    assert simhash.keep_one(empty).collect() == []


def test_rows_that_share_an_id_are_told_apart(spark):
    """Id 5 holds a copy of document 1 and two texts of its own; rows without an
    id repeat each other, or a document that has one."""
    rng = random.Random(8)
    a, b, c, d = (" ".join(f"w{rng.randrange(10_000)}" for _ in range(80)) for _ in range(4))
    rows = [(1, a), (5, a), (5, b), (5, c), (7, c), (None, d), (None, d), (None, b), (5, b)]
    prints = [brute_print(t) for t in (a, b, c, d)]
    assert all((x ^ y).bit_count() > 3 for i, x in enumerate(prints) for y in prints[:i])
    for seed in range(3):
        rng.shuffle(rows)
        docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, th string").repartition(seed + 1)
        got = [(r.doc_id, r.text) for r in simhash.keep_one(docs).collect()]
        assert sorted(got, key=str) == sorted([(1, a), (5, b), (5, c), (None, d)], key=str)
