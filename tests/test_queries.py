"""Every query with SQL against DuckDB at the smallest scale."""

import duckdb
import pytest

from provmart.plans import panels, registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


QUERIES, SQL = registry.QUERIES | panels.QUERIES, registry.SQL | panels.SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    cur = db.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted(repr(tuple(r[names.index(c)] for c in cols)) for r in cur.fetchall())
    assert got == want


def test_robots_query(spark):
    rows = registry.QUERIES["robots_allows"](spark, SF).collect()
    assert {r.allowed for r in rows} <= {True, False} and len({r.allowed for r in rows}) == 2
