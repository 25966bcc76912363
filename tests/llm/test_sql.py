"""Every query of the subpackage that has SQL, against it, on the smallest tables."""

import os

import duckdb
import pytest

from passagekit.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF, t)}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    order = lambda rows: sorted(rows, key=lambda r: [(x is None, x) for x in r])
    rel = con.sql(ORACLE_SQL[name])
    assert sorted(rel.columns) == cols
    want = [tuple(r[rel.columns.index(c)] for c in cols) for r in rel.fetchall()]
    assert order(tuple(r[c] for c in cols) for r in df.collect()) == order(want)
