"""Article -> sections rules (F1-F10, P4): hand-written cases."""

import pytest
from pyspark.sql import functions as F

from passagekit.functions.text import py_strip
from passagekit.operators import corpus
from passagekit.sources import fixtures as fx

L = "x" * 60                     # a line long enough to be kept
E49, E50 = "h" * 43, "h" * 44    # make headings of 49 and 50 characters

# Article and the texts of its sections, written out rule by rule.
CASES = [
    ("== References ==\n" + L, [""]),                                   # stops at once, the lead is empty
    ("== A heading ==\n== Another one ==", ["", "A heading.", "Another one."]),
    ("=======\n" + L, ["", "\n" + L]),                                  # heading without a name
    (f"== {E49} ==\n{L}", ["", f"{E49}.\n{L}"]),
    (f"== {E50} ==\n{L}", ["", f"{E50}.\n== {E50} ==\n{L}"]),           # long enough to stay as a line too
    ("== " + "h" * 94 + " ==\n" + L, [L]),                              # 100 characters: dropped
    ("== Ends with dot. ==\n" + L, ["", "Ends with dot.\n" + L]),
    (L + "\n======== Notes ========\n" + L, [L + "\n" + L]),            # blocked name
    (L + "\n======== See also ========\n" + L, [L + "\nSee also.\n" + L]),   # appended, no new section
    (L + "\n=== References ===\n" + L, [L]),
    (L + "\n==references==\n" + L, [L]),
    (L + "\n== REFERENCES ==\n" + L, [L, "REFERENCES.\n" + L]),
    ("\t" + L + "\xa0\n\x1c" + L + "\x85", [L + "\n" + L]),            # outer white space
    ("\u200b" + L + "\u200b", ["\u200b" + L + "\u200b"]),               # zero-width space is kept
    ("\U0001f600" * 49 + "\n" + "\U0001f600" * 50, ["\U0001f600" * 50]),  # length in characters
    ("{" + L + "}\n" + L, [L]),
    ("= X =\n" + L, [L]),                                               # short heading
    ("", [""]),
    ("\n\n\n", [""]),
    ("This may refer to: " + L, ["This may refer to: " + L]),
]


@pytest.fixture(scope="module")
def cases(spark):
    rows = [(i, t) for i, (t, _) in enumerate(CASES)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_cases_rule_by_rule(cases):
    got = corpus.article_sections(cases).orderBy("doc_id", "sec").collect()
    assert [(r.doc_id, r.sec, r.text) for r in got] == [(i, k, s) for i, (_, x) in enumerate(CASES) for k, s in enumerate(x)]


def test_first_sentence_is_prefix(cases):
    for r in corpus.article_sections(cases).select("doc_id", "first_sentence").distinct().collect():
        assert r.first_sentence == CASES[r.doc_id][0][:100]


def test_filter(cases):
    got = corpus.filter_sections(corpus.article_sections(cases)).orderBy("doc_id", "sec").collect()
    want = [(i, s) for i, (_, x) in enumerate(CASES) for s in x if len(s) >= 50 and "may refer to" not in s[:100].lower()]
    assert [(r.doc_id, r.text) for r in got] == want


def test_strip_matches_python(spark):
    samples = ["\t a \n", "\xa0b　", "\x1cc\x1f", "​d​", "\x85e\x85", "  ", "f"]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    got = [r[0] for r in df.select(py_strip(F.col("s"))).collect()]
    assert got == [s.strip() for s in samples]


def test_section_lines_content_joins_to_sections(cases):
    lines = corpus.section_lines(cases).toPandas()
    assert set(lines["kind"]) >= {"empty", "references", "heading_break", "heading_append",
                                  "heading_dropped", "short", "latex", "text"}
    # stopped lines contribute nothing
    assert (lines[lines.stopped]["content"] == "").all()


def test_sectioning_plan_has_no_exchange(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = corpus.article_sections(fx.articles(docs))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_section_headers(spark):
    from passagekit.functions.text import passage_text, section_headers
    text = "x" * 60 + "\n== History ==\n" + "y" * 60 + "\n=======\n" + "z" * 60
    df = corpus.article_sections(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    rows = df.select("sec", section_headers(F.col("text"), F.col("sec")).alias("headers")).orderBy("sec").collect()
    assert [(r.sec, r.headers) for r in rows] == [(0, ""), (1, "History."), (2, "")]
    tagged = df.withColumn("headers", section_headers(F.col("text"), F.col("sec"))) \
        .select(passage_text(add_tags=True, prefix="passage: ").alias("p")).orderBy("p").collect()
    assert any(r.p.startswith("History. passage: History.\n") for r in tagged)
