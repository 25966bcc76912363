"""Re-ranking and context assembly edge cases."""

import numpy as np

from passagekit.operators import encode, retrieve


def vec(spark, rows, key):
    return spark.createDataFrame(rows, f"{key} long, embedding array<float>")


def test_context_edges(spark):
    enc = encode.HashingEncoder(16)
    questions = spark.createDataFrame(
        [(0, "alpha beta", "a", "b", None, "d", "e", "A"), (1, "zeta", "a", "b", "c", "d", "e", "B")],
        "prompt_id long, prompt string, A string, B string, C string, D string, E string, answer string")
    hits = spark.createDataFrame([(0, 1, 10, 0.0)], "prompt_id long, rank int, id long, dist double")
    sections = spark.createDataFrame([(10, "  alpha beta  \n\npassage: alpha\ngamma")], "id long, text string")
    lines = encode.encode(retrieve.split_lines(sections), enc)
    qv = encode.encode(questions.selectExpr("prompt_id", "prompt as text"), enc).withColumnRenamed("embedding", "qvec")
    ranked = retrieve.rerank(hits, lines, qv, k=35)
    ctx = {r.prompt_id: r.context for r in retrieve.context_dataset(questions, retrieve.build_context(ranked)).collect()}
    # prompt 1 has no candidate lines -> empty context; prompt 0 gets all 4 lines (fewer than k)
    assert ctx[1] == ""
    parts = ctx[0].split("<SS>")
    assert parts[-1] == "" and len(parts) == 5
    assert parts[0] == "alpha beta"            # stripped, best match first
    assert "passage: alpha" in parts           # a line starting with the prefix is kept as is
    assert "" in parts                         # the empty line is kept


def test_rerank_top_k_and_ties(spark):
    hits = spark.createDataFrame([(0, 1, 1, 0.0), (0, 2, 2, 0.0)], "prompt_id long, rank int, id long, dist double")
    lines = spark.createDataFrame(
        [(1, 0, "x", [1.0, 0.0]), (1, 1, "y", [1.0, 0.0]), (2, 0, "z", [0.0, 1.0]), (2, 1, "w", [1.0, 0.0])],
        "document_id long, pos int, text string, embedding array<float>")
    qv = spark.createDataFrame([(0, [1.0, 0.0])], "prompt_id long, qvec array<float>")
    got = [(r.rank, r.document_id, r.pos) for r in retrieve.rerank(hits, lines, qv, k=3).orderBy("rank").collect()]
    assert got == [(1, 1, 0), (2, 1, 1), (3, 2, 1)]


def test_load_articles_prunes_partitions(spark):
    from pyspark.sql import functions as F

    from passagekit.session import scratch_path
    path = scratch_path(spark, "t-sections")
    spark.range(0, 100).select(F.col("id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"),
                               F.lit("").alias("first_sentence"), (F.col("id") / 10).cast("int").alias("file")) \
        .write.partitionBy("file").parquet(path)
    sections = spark.read.parquet(path)
    hits = spark.createDataFrame([(5, 0, 0), (42, 0, 4), (5, 1, 0)], "id long, prompt_id long, file int")
    out = retrieve.load_articles(hits, sections)
    assert sorted(r.id for r in out.collect()) == [5, 42]
    plan = out._sc._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "formatted")
    filters = [ln for ln in plan.split("\n") if ln.startswith("PartitionFilters")]
    assert filters and "dynamicpruning" in filters[0]


def test_sectionize_and_split(spark):
    df = spark.createDataFrame([(3, "a\n\nb "), (1, "")], "id long, text string")
    s = {r.document_id: (r.offset.start, r.offset.end) for r in retrieve.sectionize(df).collect()}
    assert s == {3: (0, 5), 1: (0, 0)}
    lines = sorted((r.document_id, r.pos, r.text) for r in retrieve.split_lines(df).collect())
    assert lines == [(1, 0, ""), (3, 0, "a"), (3, 1, ""), (3, 2, "b ")]


def test_hot_section_is_salted(spark, monkeypatch):
    """One section hit by every question."""
    monkeypatch.setattr(retrieve, "HITS_PER_TASK", 3)
    hits = spark.createDataFrame([(i, 1, 7, 0.0) for i in range(20)], "prompt_id long, rank int, id long, dist double")
    lines = spark.createDataFrame([(7, 0, "x", [1.0, 0.0]), (7, 1, "y", [0.0, 1.0])],
                                  "document_id long, pos int, text string, embedding array<float>")
    qv = spark.createDataFrame([(i, [float(i % 2), float(1 - i % 2)]) for i in range(20)], "prompt_id long, qvec array<float>")
    got = retrieve.rerank(hits, lines, qv, k=1).collect()
    assert sorted((r.prompt_id, r.text) for r in got) == [(i, "x" if i % 2 else "y") for i in range(20)]
