"""Sources and sinks: CSV, API JSON, save modes, output names."""

import pytest
from pyspark.errors import AnalysisException

from passagekit.session import scratch_path
from passagekit.sources import fixtures as fx
from passagekit.sources import readers, writers

ROWS = [
    (7, 'Say "hi", then\nleave?', "a,b", "None", "", "d", "NA", "B"),
    (3, "plain", "x", "y", "z", "w", "v", "E"),
]
SCHEMA = "id long, prompt string, A string, B string, C string, D string, E string, answer string"


def _write(spark, rows, cols=None):
    df = spark.createDataFrame(rows, SCHEMA)
    if cols:
        df = df.select(*cols)
    path = scratch_path(spark, "t-csv")
    (df.coalesce(1).write.option("header", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return path


def test_questions_csv_roundtrip(spark):
    q = readers.read_questions_csv(spark, _write(spark, ROWS)).orderBy("prompt_id").collect()
    assert [r.prompt_id for r in q] == [0, 1]          # row position, not the id column
    assert q[0].prompt == 'Say "hi", then\nleave?' and q[0].A == "a,b"
    assert q[0].B is None and q[0].C is None and q[0].E is None   # NA tokens and empty -> null
    assert "id" not in readers.read_questions_csv(spark, _write(spark, ROWS)).columns


def test_questions_csv_without_id_unlabeled(spark):
    path = _write(spark, ROWS, ["prompt", "A", "B", "C", "D", "E"])
    q = readers.read_questions_csv(spark, path, unlabeled=True).collect()
    assert {r.answer for r in q} == {"A"} and len(q) == 2


def test_extract_api_failures(spark):
    docs = spark.createDataFrame([(1, "text one"), (11, "x"), (13, "y"), (2, "")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in readers.extract_api(fx.api_responses(docs)).collect()}
    assert got == {1: "text one", 11: "", 13: "", 2: ""}
    raw = spark.createDataFrame([(1, '{"query":{"pages":{"9":{"title":"t"}}}}'),
                                 (2, '{"query":{"pages":{"5":{"extract":"a"},"4":{"extract":"b"}}}}')],
                                "doc_id long, body string")
    got = {r.doc_id: r.text for r in readers.extract_api(raw).collect()}
    assert got == {1: "", 2: "a"}


def test_save_modes(spark):
    df = spark.range(3)
    path = scratch_path(spark, "t-modes")
    df.write.mode("errorifexists").parquet(path)
    with pytest.raises(AnalysisException):
        df.write.mode("errorifexists").parquet(path)
    spark.range(10).write.mode("ignore").parquet(path)
    assert spark.read.parquet(path).count() == 3
    spark.range(10).write.mode("overwrite").parquet(path)
    assert spark.read.parquet(path).count() == 10


def test_context_csv_sink(spark):
    df = spark.createDataFrame([("p,1", 'c "q"\nx<SS>', " a ", "b", None, "d", "e", "A")],
                               "prompt string, context string, A string, B string, C string, D string, "
                               "E string, answer string")
    path = scratch_path(spark, "t-ctx")
    writers.write_context_csv(df, path)
    back = readers.read_questions_csv(spark, path, columns=writers.CONTEXT_COLUMNS).first()
    assert back.prompt == "p,1" and back.context == 'c "q"\nx<SS>' and back.C is None
    assert back.A == " a "


def test_output_name():
    n = writers.output_name("out", "idx/e5-base-v2_v14_0_0.index", "train.csv", "intfloat/e5-base-v2", 20, "v14")
    assert n == "out/e5-base-v2_v14_0_0__train_e5-base-v2_20_v14.csv"
    n = writers.output_name("out", "idx/e5-base-v2_v14_0_0", "all_data.csv", "intfloat/e5-base-v2", 5, "v14", True)
    assert n == "out/e5-base-v2_v14_0_0_sharded__all_data_e5-base-v2_5_v14.csv"


def test_questions_csv_positions_across_files(spark):
    from pyspark.sql import functions as F
    df = spark.range(0, 50).select(F.col("id"), F.concat(F.lit("q"), F.col("id").cast("string")).alias("prompt"),
                                   *[F.lit(c.lower()).alias(c) for c in "ABCDE"], F.lit("A").alias("answer"))
    path = scratch_path(spark, "t-csv-multi")
    writers.write_csv(df.repartitionByRange(3, "id").sortWithinPartitions("id"), path,
                      ["id", "prompt", "A", "B", "C", "D", "E", "answer"])
    back = readers.read_questions_csv(spark, path).orderBy("prompt_id").collect()
    assert [r.prompt for r in back] == [f"q{i}" for i in range(50)]
    assert [r.prompt_id for r in back] == list(range(50))
