import numpy as np
import pytest

from passagekit.llm import quality_rules as q

SF = "/root/testdata/sf0.01"


def brute_stats(text):
    w = (text or "").encode().split()
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    grams = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    cover = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 8)}
    return (len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text or ""), dup, len(cover))


def test_statistics_and_base_rule(spark, wide):
    out = q.judge(wide, spark.createDataFrame([], "doc_id long, quality int"), "v")
    for r in out.select("text", "v.*").collect():
        if r.text and len(r.text) > 20_000:
            continue
        n, chars, symbols, dup, repeat = want = brute_stats(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (n < 20 or 100 * repeat > 30 * n)
        assert r.kept == (not r.base_failed)             # no labels: no rules
    assert set(wide.columns) < set(out.columns)


def test_covering_learns_conjunctions():
    rng = np.random.default_rng(0)
    x = {"a": rng.random(2000), "b": rng.random(2000)}
    bad = ((x["a"] > 0.7) & (x["b"] < 0.4)) | (x["a"] < 0.05)
    hit = np.zeros(2000, bool)
    for rule in q.learn_rules(x, bad):
        hit |= q.covers(x, rule)
    assert (hit == bad).mean() > 0.98
    assert q.learn_rules(x, np.zeros(2000, bool)) == []
    ties = {"a": np.ones(50)}
    assert q.learn_rules(ties, np.arange(50) < 25) == []


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    train, test = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    rows = q.judge(docs, train, "v").join(test, "doc_id").select("v.kept", "v.base_failed", "quality").toPandas()
    assert rows[rows.quality == 0].kept.mean() < 0.1
    assert rows[(rows.quality == 1) & ~rows.base_failed].kept.mean() > 0.98


def test_empty_and_columns(spark, wide, empty):
    labels = spark.createDataFrame([(1, None), (None, 0), (5, 1), (5, 0)], "doc_id long, quality int")
    assert q.keep_good(empty, labels).collect() == []
    assert q.keep_good(wide, labels).columns == wide.columns


@pytest.mark.parametrize("n", [1, 7, 8, 9, 40])
def test_repeat_words_small(n):
    ids = np.arange(n) % 5
    text = " ".join(f"w{i}" for i in ids)
    assert q.repeat_words(ids.astype(np.int64)) == brute_stats(text)[4]
