"""The whole pipeline against a plain Python version of each stage."""
import hashlib
import random
from collections import Counter
from math import floor

import corpus_pipeline
from conftest import DOCS
from passagekit.llm import mixing
from test_decontamination import want
from test_quality_rules import brute_stats
from test_sharding_mixing import fill
from test_simhash import brute_groups, brute_print


def case():
    """``rows`` of documents, ``labels``, ``items``: clean texts, texts of symbols,
    short and repetitive ones, nulls, copies, near copies, leaks, repeated ids."""
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(1500)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, say(14)) for i in range(2)]
    texts = [say(rng.randint(22, 70)) for _ in range(90)]
    bad = [" ".join("#" + w[1:] for w in say(rng.randint(22, 70)).split()) for _ in range(30)]
    labels = [(i, 1) for i in range(70)] + [(90 + i, 0) for i in range(22)]
    near = texts[4] + "."
    leaks = [say(15) + " " + items[i % 2][1].upper() + "\n" + say(15) for i in range(6)]
    texts += [*bad, None, "", say(19), "ab cd " * 60, texts[3], texts[3], near, *leaks]
    rows = [(i, t) for i, t in enumerate(texts)]
    lone = say(40)
    rows += [rows[7], (3, say(33)), (None, lone), (None, lone), (None, None), (None, texts[5])]
    rows = [(i, t, ["en", "de", None][k % 3], [f"src{k % 4}", None][k % 11 == 0], len(t or "")) for k, (i, t) in enumerate(rows)]
    rows[-3] = rows[-4]
    rows[len(texts)] = rows[7]
    return rows, labels, items


def good(rows):
    def ok(t):
        n, _, symbols, _, repeat = brute_stats(t)
        return n >= 20 and 100 * repeat <= 30 * n and symbols == 0
    return [r for r in rows if ok(r[1])]


def one_of_each(rows):
    """The smallest id of each group; a row without an id only where the group has none."""
    low = brute_groups([r[:2] for r in rows], [brute_print(r[1]) for r in rows])
    return sorted({r for r, c in zip(rows, low, strict=True) if r[0] == c}, key=str)


def without_leaks(rows, items):
    leaked = {i for i, _ in want([(k, r[1]) for k, r in enumerate(rows)], items)}
    return [r for k, r in enumerate(rows) if k not in leaked]


def mixture(rows):
    """Each leaf's prefix by tokens in the order of the hash, one epoch at most."""
    def place(r):
        no = int(r[3][3:]) % 3 if r[3] else 3
        return ["web", "books", "code", "other"][no], r[2] or "", r[3] or ""
    supply = Counter()
    for r in rows:
        supply[place(r)] += len(r[1].split())
    budgets, total = {(): corpus_pipeline.MIX_SHARE * sum(supply.values())}, {}
    for level, weights in enumerate((mixing.DOMAIN_WEIGHTS, mixing.LANG_WEIGHTS, {})):
        for up, b in budgets.items():
            caps = Counter()
            for leaf, n in supply.items():
                if leaf[:level] == up:
                    caps[leaf[level]] += n
            total |= {(*up, k): x for k, x in fill(b, {k: (weights.get(k, 1), float(n)) for k, n in caps.items()}).items()}
        budgets, total = total, {}
    out = []
    for leaf, b in budgets.items():
        passes, rest = divmod(floor(b + 1e-6), supply[leaf])
        own = sorted((r for r in rows if place(r) == leaf), key=lambda r: hashlib.md5(
            f"0:{passes}:{'' if r[0] is None else r[0]}".encode()).hexdigest())
        upto = 0
        for r in own:
            upto += len(r[1].split())
            out += [r] * min(1, passes + (upto <= rest))
    return out


def test_each_stage_equals_plain_python(spark, tmp_path, monkeypatch):
    rows, labels, items = case()
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(*x, 0) for x in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages, staged = {}, corpus_pipeline.staged

    def kept(df, name):
        stages[name] = staged(df, name)
        return stages[name]

    monkeypatch.setattr(corpus_pipeline, "staged", kept)
    last = corpus_pipeline.run(spark, str(tmp_path))
    assert list(stages) == [n.replace(" ", "_") for n, _ in corpus_pipeline.STAGES]
    got = {n: sorted(map(tuple, df.select(*DOCS.names).collect()), key=str) for n, df in stages.items()}
    expect = rows
    for name, plain in (("quality_rules", good), ("near_duplicates", one_of_each),
                        ("decontamination", lambda r: without_leaks(r, items)), ("mixing", mixture)):
        after = plain(expect)
        assert 0 < len(after) < len(expect)            # every stage has something to drop
        expect = sorted(after, key=str)
        assert got[name] == expect, name
    assert got["sharding"] == expect
    slots = {}
    for r in last.select("shard", "slot").collect():
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def tables(spark, path, docs, labels, items):
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(*x, 0) for x in labels], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def test_empty_tables(spark, tmp_path, empty):
    tables(spark, str(tmp_path), empty, [], [])
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns[:5] == DOCS.names and out.collect() == []


def test_columns_with_clashing_names_go_through(spark, tmp_path):
    from conftest import CLASH
    from pyspark.sql import functions as F
    rows, labels, items = case()
    docs = spark.createDataFrame(rows, DOCS)
    names = [c for c in CLASH if c != "shard"]
    tables(spark, str(tmp_path / "a"), docs, labels, items)
    tables(spark, str(tmp_path / "b"), docs.withColumns({c: F.lit("clash") for c in names}), labels, items)
    plain, wide = (corpus_pipeline.run(spark, str(tmp_path / x)) for x in "ab")
    assert {r.s for r in wide.select("s").collect()} == {"clash"}
    assert sorted(map(str, plain.select(*DOCS.names).collect())) == sorted(map(str, wide.select(*DOCS.names).collect()))
