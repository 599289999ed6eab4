"""Every operator query with an SQL twin gives the same rows as DuckDB."""

import duckdb
import pytest

from tests.test_queries import norm, ordered
from tidemark.llm.queries import QUERIES
from tidemark.llm.sql import SQL

TABLES = "documents labels pages conversations benchmark".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def test_registry():
    assert set(SQL) <= set(QUERIES)
    assert len(QUERIES) == len({n.split("_")[0] for n in QUERIES})


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = [tuple(norm(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect()]
    rel = con.execute(SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    want = [tuple(norm(r[names.index(c)]) for c in cols) for r in rel.fetchall()]
    assert ordered(got) == ordered(want)
