import math

import pytest

from passagekit.operators import evaluate


def run(spark, rows):
    df = spark.createDataFrame(rows, "id long, preds array<double>, label int")
    return df


def reference_scores(preds, label):
    import numpy as np
    p = np.array([(-math.inf if math.isnan(x) else x) for x in preds])
    order = sorted(range(5), key=lambda i: (-p[i], i))
    r = order.index(label) + 1
    return (1 / r if r <= 3 else 0.0), float(order[0] == label)


@pytest.mark.parametrize("rows", [
    [(0, [0.1, 0.9, 0.3, 0.2, 0.0], 1), (1, [0.5, 0.5, 0.5, 0.5, 0.5], 3),
     (2, [float("nan"), 0.1, 0.2, 0.3, 0.4], 0), (3, [0.2, 0.2, 0.1, 0.0, -1.0], 1),
     (4, [0.0, 0.0, 0.0, 0.9, 0.0], 4)],
])
def test_map3_and_accuracy(spark, rows):
    out = evaluate.map_at_k(run(spark, rows), 3).first()
    exp = [reference_scores(p, label) for _, p, label in rows]
    assert out.n == len(rows)
    assert out.map_at_3 == pytest.approx(sum(e[0] for e in exp) / len(rows))
    assert out.accuracy == pytest.approx(sum(e[1] for e in exp) / len(rows))


def test_letters_first_max(spark):
    df = run(spark, [(0, [0.2, 0.9, 0.9, 0.1, 0.0], 2), (1, [float("nan"), 0.0, -1.0, 0.0, 0.0], 0)])
    got = {r.id: (r.pred, r.label) for r in evaluate.pred_letters(df).collect()}
    assert got == {0: ("B", "C"), 1: ("B", "A")}
