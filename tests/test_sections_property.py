"""Random articles from a grammar of line kinds: Spark sections == SQL sections."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

import duckdb
import pandas as pd

from passagekit.operators import corpus
from passagekit.plans import oracle

# white space that the SQL's regular expressions also strip; the rest is in test_sections
WS = [" ", "\t", "\x1c", "\u200b", ""]
WORDS = st.sampled_from(["alpha", "Beta", "gamma.", "références", "Notes", "See also", "😀", "{x}",
                         "may refer to", "References", "=", "==", "long" * 5])


def line():
    words = st.lists(WORDS, min_size=0, max_size=14).map(" ".join)
    eq = st.integers(1, 9).map(lambda n: "=" * n)
    heading = st.tuples(eq, st.sampled_from(["", " "]), words, st.sampled_from(["", " ", "."]), eq).map(
        lambda t: t[0] + t[1] + t[2] + t[3] + t[1] + t[4])
    refs = st.sampled_from(["== References ==", "==references==", "=== References ===", "== REFERENCES ==",
                            "x == References == y", "==  References  =="])
    brace = words.map(lambda w: "{" + w + "}")
    padded = st.tuples(st.sampled_from(WS), st.one_of(words, heading), st.sampled_from(WS)).map("".join)
    return st.one_of(words, heading, refs, brace, padded, st.just(""))


ARTICLES = st.lists(st.lists(line(), min_size=0, max_size=12).map("\n".join), min_size=1, max_size=40)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.too_slow, HealthCheck.data_too_large])
@given(ARTICLES)
def test_random_articles(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [(r.doc_id, r.sec, r.text) for r in corpus.article_sections(df).orderBy("doc_id", "sec").collect()]
    con = duckdb.connect()
    con.register("articles", pd.DataFrame({"doc_id": range(len(texts)), "text": texts}))
    ctes = [oracle.CTES[n][0] for n in oracle._order(["article_sections"]) if n not in ("articles", "_dl")]
    exp = con.sql("WITH " + ",\n".join(ctes) + " SELECT doc_id, sec, text FROM article_sections ORDER BY doc_id, sec").fetchall()
    assert got == exp
