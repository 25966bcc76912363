import zlib

import numpy as np
from pyspark.sql import functions as F

from passagekit.llm import mixing, sharding


def test_matrix_has_exact_sums_and_uniform_cells():
    parts, cells = np.array([5, 0, 17, 40, 3]), sharding.balanced(65, 8)
    total = np.zeros((5, 8))
    for seed in range(400):
        m = np.stack([sharding.matrix_row(parts, cells, i, seed) for i in range(5)])
        assert (m.sum(axis=0) == cells).all() and (m.sum(axis=1) == parts).all()
        total += m
    assert np.abs(total / 400 - np.outer(parts, cells) / 65).max() < 0.35


def test_draws_beyond_numpys_limit_follow_the_same_law(monkeypatch):
    """Inversion and group draws, forced by a low limit, against exact odds."""
    from math import comb
    good, bad, draws, n = 9, 14, 8, 6000
    monkeypatch.setattr(sharding, "LIMIT", 4)
    rng = np.random.default_rng(5)
    got = np.bincount([sharding._hypergeometric(rng, good, bad, draws) for _ in range(n)], minlength=9)
    want = np.array([comb(good, k) * comb(bad, draws - k) / comb(good + bad, draws) for k in range(9)])
    assert np.abs(got / n - want).max() < 0.025
    cells, pairs = np.array([3, 0, 5, 1, 2]), {}
    for _ in range(n):
        x = sharding.split_counts(rng, cells, 4)
        assert x.sum() == 4 and (x <= cells).all()
        pairs[tuple(x)] = pairs.get(tuple(x), 0) + 1
    for x, k in pairs.items():                   # the joint law, not only each cell's
        p = np.prod([comb(int(c), int(y)) for c, y in zip(cells, x)]) / comb(11, 4)
        assert abs(k / n - p) < 0.025
    assert len(pairs) == sum(1 for a in range(4) for c in range(5) for d in range(2) for e in range(3) if a + c + d + e == 4)


def test_very_large_draws():
    rng = np.random.default_rng(6)
    good, bad, draws = 3 * 10 ** 11, 7 * 10 ** 11, 10 ** 10
    x = np.array([sharding._hypergeometric(rng, good, bad, draws) for _ in range(60)], float)
    sd = (draws * 0.3 * 0.7 * 0.99) ** 0.5
    assert abs(x.mean() - 3 * 10 ** 9) < 5 * sd / 60 ** 0.5 and 0.7 < x.std() / sd < 1.3
    cells = sharding.balanced(5 * 10 ** 9, 40)
    m = sharding.split_counts(rng, cells, 2 * 10 ** 9)
    assert m.sum() == 2 * 10 ** 9 and (m <= cells).all() and np.abs(m / cells - 0.4).max() < 1e-3


def test_joint_law_of_the_matrix():
    """Every 2 x 2 matrix comes as often as the uniform shuffle has it."""
    from math import comb
    parts, cells, n = np.array([4, 3]), np.array([5, 2]), 4000
    seen = {}
    for seed in range(n):
        a = int(sharding.matrix_row(parts, cells, 0, seed)[0])
        seen[a] = seen.get(a, 0) + 1
    want = {a: comb(5, a) * comb(2, 4 - a) / comb(7, 4) for a in range(2, 5)}
    assert set(seen) == set(want) and all(abs(seen[a] / n - p) < 0.03 for a, p in want.items())


def test_shards_are_exact_gapless_and_keep_rows(spark, wide, monkeypatch):
    monkeypatch.setattr(sharding, "PART_ROWS", 7)
    for rows, most in ((wide, 1 << 16), (wide, 8), (wide.where("doc_id = 3"), 16), (wide.where("false"), 16)):
        monkeypatch.setattr(sharding, "MAX_CELLS", most)
        out = sharding.shard_rows(rows, 8, cell_rows=2)
        n = rows.count()
        got = out.groupBy("shard").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("slot")).alias("s")).collect()
        assert all(r.s == list(range(r.n)) for r in got)
        assert sum(r.n for r in got) == n
        if n:
            sizes = [r.n for r in got] + [0] * (8 - len(got))
            assert max(sizes) - min(sizes) <= 1
        keep = [c for c in rows.columns if c not in sharding.OUT]
        assert sorted(map(str, out.select(*keep).collect())) == sorted(map(str, rows.select(*keep).collect()))
        assert out.where("law <> 'rows' OR grown_shard IS NOT NULL").count() == 0


def test_query_columns(spark):
    out = sharding.op5_sharding(spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for r in out.join(docs, "doc_id").collect():
        b = r.text.encode()
        assert (r.size, r.text_crc32) == (len(b) + 1, zlib.crc32(b))
    again = sharding.op5_sharding(spark, "/root/testdata/sf0.001")
    assert sorted(map(str, out.collect())) == sorted(map(str, again.collect()))


def fill(budget, kids):
    """Water-filling by bisection-free rounds: caps first, rest by weight."""
    got, live = {k: 0.0 for k in kids}, dict(kids)
    while live and budget > 1e-9:
        w = sum(x[0] for x in live.values())
        full = {k: x for k, x in live.items() if x[1] <= budget * x[0] / w + 1e-9}
        if not full:
            return got | {k: budget * x[0] / w for k, x in live.items()}
        for k, x in full.items():
            got[k] = x[1]
            budget -= x[1]
            live.pop(k)
    return got


def test_budgets_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    supply = [(f"{d}", f"{g}", f"s{d}{g}{s}", int(rng.integers(0, 500)))
              for d in ("web", "books", "code", "other") for g in ("en", "de", "xx") for s in range(3)]
    frame = spark.createDataFrame(supply, "domain string, lang string, source string, supply long")
    for share, epochs in ((0.5, 1), (1.0, 2), (3.0, 2), (0.0, 1)):
        weights = {"domain": mixing.DOMAIN_WEIGHTS, "lang": mixing.LANG_WEIGHTS}
        got = {r.source: r.budget for r in mixing.leaf_budgets(frame, share, epochs, weights).collect()}
        total = sum(x[3] for x in supply) * share
        cap = lambda rows: float(sum(x[3] for x in rows) * epochs)
        top = fill(total, {d: (mixing.DOMAIN_WEIGHTS.get(d, 1), cap([x for x in supply if x[0] == d])) for d in {x[0] for x in supply}})
        for d, b in top.items():
            mid = fill(b, {g: (mixing.LANG_WEIGHTS.get(g, 1), cap([x for x in supply if x[:2] == (d, g)])) for g in ("en", "de", "xx")})
            for g, c in mid.items():
                for s, e in fill(c, {x[2]: (1, cap([x])) for x in supply if x[:2] == (d, g)}).items():
                    assert abs(got[s] - e) <= 1, (share, epochs, s, got[s], e)


def test_mixture_takes_prefixes_within_budget(spark, wide, empty):
    plan = mixing.plan_mixture(wide, mixing.domain_of(F.col("source")), total_share=0.6, max_epochs=1)
    rows = plan.select("domain", "lang", "source", "tokens", "budget", "copies").collect()
    assert len(rows) == wide.count() and {r.copies for r in rows} <= {0, 1}
    for leaf in {r[:3] for r in rows}:
        own = [r for r in rows if r[:3] == leaf]
        assert sum(r.tokens * r.copies for r in own) <= own[0].budget
    out = mixing.mix(wide, mixing.domain_of(F.col("source")), total_share=2.0, max_epochs=3)
    assert out.columns == wide.columns
    assert mixing.mix(empty, mixing.domain_of(F.col("source"))).collect() == []
    assert "MapInArrow" not in plan._jdf.queryExecution().toString() and "Python" not in plan._jdf.queryExecution().toString()


def test_leaves_without_tokens_and_leaves_bought_out(spark):
    """A leaf of empty texts and a leaf bought out whole: the plan equals the SQL,
    and the mixture takes no row more than ``max_epochs`` times."""
    import duckdb
    rows = [(i, ["", None, " \n"][i % 3], "en", "src0") for i in range(6)]
    rows += [(i, "" if i % 2 else "three words here", "de", "src1") for i in range(10, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    db = duckdb.connect()
    db.register("documents", docs.toPandas())
    cols = ["doc_id", *mixing.LEVELS, "tokens", "budget", "copies"]
    domain = mixing.domain_of(F.col("source"))
    plan = mixing.plan_mixture(docs, domain).select("row.doc_id", *cols[1:])
    assert sorted(map(tuple, plan.collect())) == sorted(db.execute(f"SELECT {', '.join(cols)} FROM ({mixing.ORACLE})").fetchall())
    assert max(r.copies for r in plan.collect()) <= mixing.MAX_EPOCHS
    out = [r.doc_id for r in mixing.mix(docs, domain, total_share=1.0, max_epochs=1).collect()]
    assert sorted(out) == [r[0] for r in rows]


def test_edge_bucket_is_split_until_it_is_small(spark, monkeypatch):
    """Short prefixes and a low bound: the descent goes several digits deeper and
    the plan stays the same."""
    rows = [(i if i % 50 else 7, "w " * (i % 9), ["en", "de"][i % 2], f"src{i % 2}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    plan = lambda: sorted(map(tuple, mixing.plan_mixture(docs, mixing.domain_of(F.col("source")), 0.6, 1)
                              .select("row.doc_id", *mixing.LEVELS, "tokens", "budget", "copies").collect()))
    want = plan()
    monkeypatch.setattr(mixing, "BUCKETS", 1)
    monkeypatch.setattr(mixing, "EDGE_ROWS", 2)
    assert plan() == want and {r[-1] for r in want} == {0, 1}
