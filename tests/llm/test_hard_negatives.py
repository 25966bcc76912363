import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from passagekit.llm import hard_negatives as H

COLS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def model(rows, n_pos=5, n_neg=10, scale=256):
    """Plain version over (id, label, vector); anchors: ids divisible by 10."""
    kept = [(k, i, lab, [math.floor(scale * c) for c in v]) for k, (i, lab, v) in enumerate(rows)
            if lab is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    score = lambda a, b: sum(p * q for p, q in zip(a, b))
    order = lambda r: (-r[1], r[0] is None, r[0] or 0)
    out = []
    for k, i, lab, v in kept:
        if i is None or i % 10:
            continue
        same = sorted(((j, score(v, w)) for m, j, o, w in kept if o == lab and m != k), key=order)[:n_pos]
        for p, ps in same:
            others = sorted(((j, score(v, w)) for _, j, o, w in kept if o != lab and 30 * ps <= 100 * score(v, w) <= 90 * ps), key=order)
            out += [(i, p, r + 1, j, ps, s) for r, (j, s) in enumerate(others[:n_neg])]
    return out


def table_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")


def unit(rng, n, dim, labels=4):
    v = rng.normal(size=(n, dim)) + 0.7
    return [(i, int(rng.integers(labels)), [float(c) for c in row / np.linalg.norm(row)]) for i, row in enumerate(v)]


def run(df, **kw):
    return [tuple(r[c] for c in COLS) for r in H.hard_negatives(df, F.col("id") % 10 == 0, **kw).collect()]


SORT = lambda rows: sorted(rows, key=lambda r: tuple((c is None, c or 0) for c in r))


def test_as_brute_force_over_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(H, "MIN_TILE_ROWS", 16)
    rows = unit(np.random.default_rng(1), 160, 12)
    assert SORT(run(table_of(spark, rows), tile_anchors=7, tile_bytes=32 * 8 * 12)) == SORT(model(rows))


def test_ties_repeats_nulls_and_short_vectors(spark):
    rng = np.random.default_rng(2)
    rows = unit(rng, 80, 4, 3)
    same = rows[10][2]
    rows += [(200 + i, i % 3, same) for i in range(60)]                 # a large group of equal vectors
    rows += [rows[20], rows[20], (None, 1, same), (300, None, same), (301, 1, None), (302, 1, [0.1, None, 0.2, 0.3]),
             (303, 1, [float("nan"), 0.0, 0.0, 0.0]), (304, 1, [float("inf"), 0.0, 0.0, 0.0]), (310, 2, [0.5, 0.5]), (320, 2, []),
             (330, 9, same)]                                            # an anchor alone with its label
    got, want = run(table_of(spark, rows)), model(rows)
    assert SORT(got) == SORT(want)
    assert not any(r[0] == 330 for r in got)


def test_negative_and_zero_scores(spark):
    rows = [(0, 0, [1.0, 0.0]), (1, 0, [-1.0, 0.0]), (2, 0, [0.0, 1.0]), (3, 1, [0.0, 1.0]), (4, 1, [0.5, 0.0]), (5, 1, [-0.5, 0.0]),
            (10, 1, [1.0, 0.0]), (11, 0, [0.6, 0.0]), (12, 0, [0.9, 0.0])]
    assert SORT(run(table_of(spark, rows))) == SORT(model(rows))


def test_empty_clash_and_no_anchor(spark):
    none = table_of(spark, [])
    assert H.hard_negatives(none, F.col("id") % 10 == 0).columns == COLS
    assert run(none) == []
    assert run(table_of(spark, [(1, 0, [1.0]), (2, 0, [1.0]), (3, 1, [0.5])])) == []
    rows = unit(np.random.default_rng(3), 40, 3, 2)
    wide = table_of(spark, rows).withColumns({c: F.lit("clash") for c in ["id", "key", "x", "norm", "ab", "rb", "score", "slot", "low", "rank"]})
    assert SORT(run(wide)) == SORT(model(rows))


def test_scores_beyond_a_long_are_an_error(spark):
    with pytest.raises(ValueError):
        run(table_of(spark, [(0, 0, [1e10]), (1, 0, [1e10])]))


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 200), st.integers(0, 40), st.integers(0, 1 << 30))
def test_residue_products_are_exact(dim, bits, seed):
    rng = np.random.default_rng(seed)
    top = max(1, int((2 ** (bits / 2 + 8)) / dim ** 0.5))
    a, b = rng.integers(-top, top + 1, (9, dim)), rng.integers(-top, top + 1, (11, dim))
    a[0], b[0] = top, -top
    bound = max(int((m * m).sum(axis=1).max()) for m in (a, b))
    primes = H.primes_for(bound)
    assert (H.products(H.residues(a, primes), H.residues(b, primes), primes) == a @ b.T).all()


def test_float32_sums_stay_exact():
    assert H.CHUNK * ((H.PRIME_TOP - 1) // 2) ** 2 < 1 << 24
