"""Every query with SQL, against DuckDB on whole tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = sorted(set(entry.queries()) & set(entry.oracle_sql()))
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="tables are missing")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def cell(v):
    if v is None:
        return "\0null"
    if isinstance(v, float) and math.isnan(v):
        return "\0nan"
    return f"{float(v):.8g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, duck, name):
    got = entry.queries()[name](spark, DATA)
    want = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    order = sorted(names)
    theirs = sorted(tuple(cell(r[names.index(c)]) for c in order) for r in want.fetchall())
    ours = sorted(tuple(cell(r[c]) for c in order) for r in got.collect())
    assert ours == theirs


def test_entry(spark):
    assert entry.entry(spark).count() > 0
