"""Every query with SQL agrees with it on the smallest tables; every query runs."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cur = duck.execute(SQL[name])
    cols = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(cols)
    want = sorted(repr(plain(r)) for r in cur.fetchall())
    got = sorted(repr(plain(tuple(r[c] for c in cols))) for r in df.collect())
    assert got == want


#: Queries without SQL that find nothing in the smallest tables.
EMPTY = {"articulation_links"}
#: Those that keep rows delivered twice.
AS_DELIVERED = {"p5_pages", "biconnected_links"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_other_queries_give_distinct_rows(spark, name):
    df = QUERIES[name](spark, DATA)
    rows = [repr(plain(tuple(r))) for r in df.collect()]
    assert bool(rows) != (name in EMPTY)
    assert len(rows) == len(set(rows)) or name in AS_DELIVERED


def test_entry(spark):
    assert entry.entry(spark).count() > 0
