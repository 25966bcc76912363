import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])
# Extra columns whose names the operators use inside.
CLASH = ["did", "fp", "shard", "h", "row", "s", "tokens", "a"]


def vocabulary(rng, n=400):
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéß") for _ in range(rng.randint(1, 9))) for _ in range(n)]


def odd_texts():
    """Nulls, empties, blanks, repeats, shared passages, near copies, long texts."""
    rng = random.Random(5)
    words = vocabulary(rng)
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, base = say(70), say(160)
    near = base.split()
    near[80] = "changed"
    texts = [None, "", "   \n\t ", "one", "two words", base, base, " ".join(near), say(30) + " " + passage + " " + say(30),
             passage + "\n" + say(40), say(40) + " " + passage, "ab " * 300, "x" * 1500, say(4000) + " " + passage,
             say(25), say(49), say(50), "é" * 210 + say(5), "é" * 210 + say(5), say(20) + "\r\n\x0b" + passage.replace(" ", "  ")]
    return texts


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(i, t, ["en", "de", None][i % 3], [f"src{i % 4}", None][i % 7 == 0], len(t or "")) for i, t in enumerate(odd_texts())]
    rows += [rows[5], rows[8], (None, rows[5][1], None, None, None), (None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def wide(docs):
    from pyspark.sql import functions as F
    return docs.withColumns({c: F.lit("clash") for c in CLASH})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
