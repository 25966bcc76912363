"""Dense ids, exact dedup, stats, staged build."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from passagekit.operators import corpus
from passagekit.plans import corpus_build
from passagekit.session import scratch_path
from passagekit.sources import fixtures as fx

SF = "/root/testdata/sf0.001"


def _kept(spark):
    return corpus.clean_sections(fx.articles(spark.read.parquet(f"{SF}/documents.parquet")))


def test_dense_index_equals_global_row_number(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7 % 1013).alias("k"))
    for b in (1, 3, 50, 10_000):
        got = corpus.dense_index(df, ["k"], corpus.idiv("k", b), "pos")
        w = Window.orderBy("k")
        exp = df.withColumn("pos", F.row_number().over(w) - 1)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, exp.collect()))


def _staged(spark, kept):
    path = scratch_path(spark, "t-staged")
    kept.withColumn("h", F.sha2("text", 256)).write.parquet(path)
    return spark.read.parquet(path)


def test_ids_dense_and_files(spark):
    ids = corpus_build.ids_staged(_staged(spark, _kept(spark)), rows_per_file=50, rows_per_range=20).toPandas()
    assert sorted(ids["id"]) == list(range(len(ids)))
    assert (ids["file"] == ids["id"] // 50).all()
    order = ids.sort_values(["doc_id", "sec"])["id"].tolist()
    assert order == sorted(order)


def test_dedup_keeps_first_copy_and_is_idempotent(spark):
    kept = _kept(spark)
    d1 = corpus_build.dedup_staged(_staged(spark, kept), 50).toPandas()
    assert len(d1) == 309 and d1["text"].is_unique
    assert sorted(d1["id"]) == list(range(len(d1)))
    allk = kept.toPandas().sort_values(["doc_id", "sec"])
    first = allk.drop_duplicates("text", keep="first")
    assert sorted(zip(first.doc_id, first.sec)) == sorted(zip(d1.doc_id, d1.sec))
    again = spark.createDataFrame(d1[["doc_id", "sec", "text", "first_sentence"]])
    assert corpus_build.dedup_staged(_staged(spark, again), 50).count() == len(d1)


def test_numbering_never_runs_in_one_task(spark):
    """No exchange of key rows to a single partition, at the smallest size."""
    ids = corpus_build.ids_staged(_staged(spark, _kept(spark)), 50)
    plan = ids._jdf.queryExecution().executedPlan().toString()
    single = [x for x in plan.split("\n") if "SinglePartition" in x]
    assert "Window" not in plan or all("_n" in plan[plan.index(x):][:600] for x in single)


def test_hot_copy_group(spark):
    """A third of all sections are the same text: result still exact."""
    hot = "the same paragraph repeated many times over " * 3
    rows = [(i, 0, hot if i % 3 == 0 else f"unique text number {i} " * 5, "") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, sec int, text string, first_sentence string")
    out = corpus_build.dedup_staged(_staged(spark, df), 100, rows_per_range=37).toPandas()
    assert len(out) == 401
    assert out.loc[out.text == hot, "doc_id"].tolist() == [0]


def test_staged_build_writes_partitioned_tables(spark):
    arts = fx.articles(spark.read.parquet(f"{SF}/documents.parquet"))
    paths = corpus_build.build_corpus(arts, scratch_path(spark, "t-corpus"), rows_per_file=100)
    sec = spark.read.parquet(paths.sections)
    meta = spark.read.parquet(paths.metadata)
    assert sec.count() == 309 and meta.count() == 309
    assert sorted(r.file for r in sec.select("file").distinct().collect()) == [0, 1, 2, 3]
    assert sec.join(meta, ["id", "file"]).count() == 309


def test_dense_index_ranges_clustered_keys(spark):
    """Ids clustered far apart and a hot cluster: ranges stay balanced, ids exact."""
    from passagekit.session import scratch_path
    rows = [(i, 0) for i in range(50)] + [(10**15 + i, j) for i in range(30) for j in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, sec int")
    out = corpus.dense_index_ranges(df, ["doc_id", "sec"], "id", scratch_path(spark, "t-rng"), rows_per_range=37)
    got = sorted((r.doc_id, r.sec, r.id) for r in out.collect())
    assert [g[2] for g in got] == list(range(len(rows)))
    keyed = spark.read.parquet(out.inputFiles()[0].rsplit("/", 1)[0])
    sizes = [r[1] for r in keyed.groupBy("_r").count().collect()]
    assert len(sizes) > 10 and max(sizes) <= 3 * 37


def test_staged_dedup_many_ranges_equals_single(spark):
    from passagekit.session import scratch_path
    arts = fx.articles(spark.read.parquet(f"{SF}/documents.parquet"))
    staged = corpus_build.stage_sections(arts, scratch_path(spark, "t-staged"))
    a = corpus_build.dedup_staged(staged, 50, rows_per_range=13).select("id", "doc_id", "sec", "file").collect()
    b = corpus_build.dedup_staged(staged, 50).select("id", "doc_id", "sec", "file").collect()
    assert sorted(a) == sorted(b) and len(a) == 309
    st = {(r.file, r.is_total): r for r in corpus_build.stats_staged(staged, 250, rows_per_range=11).collect()}
    assert (st[(None, True)].original, st[(None, True)].duplicated) == (339, 30)
