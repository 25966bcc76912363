"""Every registered query of the reference's operators against its DuckDB SQL
on the smallest tables."""

import hashlib
import json
import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from passagekit.plans import registry
from passagekit.plans.context import Inputs
from passagekit.plans.oracle import oracle_sql
from passagekit.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ["documents", "embeddings", "benchmark"]


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


def _digest(rows):
    return hashlib.sha256("\n".join(sorted(json.dumps([_norm(x) for x in r], default=str)
                                          for r in rows)).encode()).hexdigest()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF, t)}.parquet')")
    return c


@pytest.fixture(scope="module", autouse=True)
def one_corpus():
    """The queries' common inputs are built once for the module."""
    made = {}
    with pytest.MonkeyPatch.context() as m:
        m.setattr(registry, "_i", lambda spark, d: made.setdefault(d, Inputs(spark, d)))
        yield


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = [tuple(r[c] for c in cols) for r in df.collect()]
    rel = con.sql(oracle_sql()[name])
    assert sorted(rel.columns) == cols
    idx = [rel.columns.index(c) for c in cols]
    exp = [tuple(r[i] for i in idx) for r in rel.fetchall()]
    assert len(got) == len(exp)
    assert _digest(got) == _digest(exp)


def test_every_query_has_sql_and_is_registered():
    assert set(oracle_sql()) <= set(QUERIES)
    assert set(QUERIES) <= set(E.queries()) and set(oracle_sql()) <= set(E.oracle_sql())


def test_entry_without_the_optional_subpackage(monkeypatch):
    import sys
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)      # its import fails
    assert set(E.queries()) == set(QUERIES) and set(E.oracle_sql()) == set(oracle_sql())


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["prompt_id", "prompt", "context", "A", "B", "C", "D", "E", "answer"]
    assert df.count() == 40
