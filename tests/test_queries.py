"""Every registered query of the engine against DuckDB on the same files."""

import datetime
import decimal

import duckdb
import pytest

from sparrowmill.queries import ORACLE_SQL, QUERIES

NAMES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for n in NAMES:
        c.execute(f"CREATE VIEW {n} AS SELECT * FROM read_parquet('{sf}/{n}.parquet')")
    return c


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    return str(v) if isinstance(v, (datetime.date, datetime.datetime)) else v


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    res = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    want = sorted(repr([plain(dict(zip(names, r))[c]) for c in cols]) for r in res.fetchall())
    assert got == want


def test_entry(spark):
    import __spark_entry__ as s

    assert s.entry(spark).count() > 0
    assert set(s.oracle_sql()) <= set(s.queries())
