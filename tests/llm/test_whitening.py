import numpy as np
import pytest
from pyspark.sql import functions as F

from passagekit.llm import whitening as W


def model(vectors, k=16, scale=64, base=1_000_000):
    """Plain version over (id, vector): rows kept, covariance by its definition."""
    kept = [(i, v) for i, v in vectors if v and all(c is not None and np.isfinite(c) for c in v)]
    dim = max((len(v) for _, v in kept), default=0)
    x = [(i, tuple(int(np.floor(scale * c)) + base for c in v) + (base,) * (dim - len(v))) for i, v in kept]
    fit = sorted({v for _, v in x})
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[(n * c - t) / n for c, t in zip(v, s)] for v in fit])
    _, sigma, axes = np.linalg.svd(centred, full_matrices=False)
    lam, axes = sigma ** 2 / n, axes.T
    k = min(k, int((sigma > 1e-10 * sigma[0]).sum()))
    out = {}
    for i, v in x:
        c = np.array([(n * a - t) / n for a, t in zip(v, s)])
        out.setdefault(i, []).append((n, sum((n * a - t) ** 2 for a, t in zip(v, s)), c @ axes[:, :k] / np.sqrt(lam[:k])))
    return out, lam[:k] / lam.sum(), k


def vectors(seed, n, dim, spread=1.0):
    rng = np.random.default_rng(seed)
    mix = rng.normal(size=(dim, dim)) * np.logspace(0, -spread, dim)
    return [(i, [float(c) for c in row]) for i, row in enumerate(rng.normal(size=(n, dim)) @ mix)]


def check(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = W.whiten(df, **kw).collect()
    want, explained, k = model(rows, **{"k": kw.get("components", 16)})
    assert len(got) == k * sum(map(len, want.values()))
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.component), []).append(r)
    signs = {}
    for i, each in want.items():
        for c in range(1, k + 1):
            mine = by[i, c]
            assert sorted((r.n, r.deviation) for r in mine) == sorted((n, d) for n, d, _ in each)
            a, b = sorted(r.whitened for r in mine), sorted(w[c - 1] for *_, w in each)
            if c not in signs and abs(b[0]) > 1e-3:
                signs[c] = 1 if np.allclose(a, b, atol=1e-6) else -1
            assert np.allclose(a, sorted(signs.get(c, 1) * x for x in b), atol=1e-6)
            assert all(abs(r.explained / explained[c - 1] - 1) < 1e-6 and r.identity_error < 1e-6 for r in mine)
    return got


def test_whitening_is_that_of_the_definition(spark):
    rows = vectors(1, 300, 20)
    rows += [(500 + i, rows[7][1]) for i in range(150)] + [(7, rows[7][1])]      # a third of all rows are one vector
    check(spark, rows)


def test_hard_conditioning(spark):
    check(spark, [(i, [v[0] * 1e4, *v[1:]]) for i, v in vectors(2, 200, 8, 2.0)])


def test_left_out_short_and_flat_vectors(spark):
    rows = vectors(3, 60, 5)
    rows = [(i, [*v, 0.25]) for i, v in rows]                                    # a dimension without variance
    rows += [(100, None), (101, []), (102, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (103, [float("nan")] * 6), (104, [float("inf")] * 6),
             (105, [0.5, -0.5]), (None, [0.1] * 6)]
    got = check(spark, rows)
    assert {r.component for r in got} == set(range(1, 7))
    assert {r.vec_id for r in got} >= {105, None} and not {r.vec_id for r in got} & set(range(100, 105))
    # without the short row the sixth direction is empty
    assert {r.component for r in check(spark, rows[:60])} == set(range(1, 6))


def test_linear_dependence(spark):
    # whole 64ths, so that flooring keeps the dependence exact
    rows = [(i, [round(c * 64) / 64 for c in v]) for i, v in vectors(4, 80, 4)]
    rows = [(i, [*v, v[0] + v[1]]) for i, v in rows]
    assert {r.component for r in check(spark, rows)} == {1, 2, 3, 4}


def test_empty_and_single(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert W.whiten(none).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert W.whiten(none).count() == 0
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert W.whiten(one).count() == 0
    assert W.whiten(one.where("vec_id = 3")).count() == 0


def test_clashing_columns_and_fewer_components(spark):
    rows = vectors(5, 40, 6)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns(
        {c: F.lit("clash") for c in ["x", "c", "id", "component", "n", "at", "v", "whitened"]})
    assert W.whiten(df, components=2).count() == 80


def test_deviation_beyond_a_long_is_null():
    x = np.array([[1 << 40, 0], [0, 0]])
    sums = [1 << 40, 0]
    assert W.deviations(x, 2, sums) == [None, None]
    assert W.deviations(x >> 20, 2, [1 << 20, 0]) == [1 << 40, 1 << 40]


def test_sums_do_not_overflow(spark):
    big = spark.createDataFrame([([1 << 62, -(1 << 62)],)] * 4, "x array<long>")
    assert W.integer_sums(big, 2, 0) == (4, [1 << 64, -(1 << 64)])


@pytest.mark.parametrize("dim", [1, 3, 30])
def test_triangular_solve(dim):
    rng = np.random.default_rng(dim)
    r = np.triu(rng.normal(size=(dim, dim))) + 3 * np.eye(dim)
    rows = rng.normal(size=(7, dim))
    assert np.allclose(W.solve_rows(rows, r) @ r, rows)
