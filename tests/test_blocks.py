"""Joins with many partners a row: block by block, dealt by the number of pairs, with the rows that the plain join has."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from sparrowmill.queries import ORACLE_SQL, QUERIES
from sparrowmill.session import Engine

L, R = "k INT, j DOUBLE, x BIGINT, s STRING", "k INT, j DOUBLE, y BIGINT, s STRING"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Null and hot keys, copies, both zeros and NaN; the right table is the smaller."""
    odd = [0.0, -0.0, math.nan, None, 1.0]

    def rows(n):
        return [(None if i % 11 == 0 else 7 if i % 2 else i % 5, odd[i % 5], i // 3, None if i % 13 == 0 else f"s{i % 4}") for i in range(n)]

    at = tmp_path_factory.mktemp("blocks")
    for name, schema, n in (("l", L, 900), ("r", R, 300)):
        spark.createDataFrame(rows(n), schema).coalesce(1).write.parquet(f"{at}/{name}")
    return {name: spark.read.parquet(f"{at}/{name}") for name in "lr"}


def over(spark, tables, **options):
    e = Engine(spark, **options)
    for name, df in tables.items():
        e.register(name, df)
    return e


@pytest.mark.parametrize(
    "text",
    [
        "SELECT x, y FROM l, r WHERE l.k = r.k",
        "SELECT y, l.s AS s FROM r, l WHERE r.k = l.k AND l.x > 20 AND r.y < 70",
        "SELECT x, y FROM l, r WHERE l.k = r.k AND l.j = r.j",
        "SELECT x, r.j AS j FROM l, r WHERE l.j = r.j AND l.x < r.y",
        "SELECT x + y AS z FROM l, r WHERE l.k = r.k AND (l.s = r.s OR x = y) AND TRUE",
        "SELECT x, y FROM l, r WHERE l.k = r.j AND r.j = l.j",
        "SELECT x FROM l, r WHERE l.s = r.s",
        "SELECT * FROM l, r WHERE l.k = r.k",
        "SELECT a.y AS p, b.y AS q FROM r AS a, r AS b WHERE a.k = b.k AND a.y < b.y",
        "SELECT x, y FROM l, r WHERE l.k = r.k ORDER BY y DESC, x LIMIT 40",
        "SELECT q.x AS x, COUNT(*) AS n FROM (SELECT x, y FROM l, r WHERE l.k = r.k) AS q GROUP BY q.x",
    ],
)
def test_same_rows(spark, tables, text):
    blocks, plain = over(spark, tables, fan_out=2), over(spark, tables, fan_out=10**9)
    assert "#blocks" in blocks.plan(text).sql and "#blocks" not in plain.plan(text).sql
    a, b = blocks.sql(text), plain.sql(text)
    assert a.dtypes == b.dtypes
    got, want = (sorted(repr(r) for r in df.collect()) for df in (a, b))
    assert got == want and got


@pytest.mark.parametrize("text", ["SELECT x, y FROM l, r WHERE l.k = r.k LIMIT 3", "SELECT x, y FROM l, r WHERE l.k < r.k", "SELECT COUNT(*) AS n FROM l, r WHERE l.k = r.k", "SELECT x, y FROM l, r WHERE l.k = r.k AND y > (SELECT AVG(y) FROM r AS o)"])
def test_other_joins_stay(spark, tables, text):
    assert "#blocks" not in over(spark, tables, fan_out=2).plan(text).sql


def test_few_partners_hints_and_empty_tables_stay(spark, tables):
    text = "SELECT x, y FROM l, r WHERE l.k = r.k"
    assert "#blocks" not in over(spark, tables, fan_out=2, join_hint="MERGE").plan(text).sql
    assert "#blocks" not in over(spark, tables, fan_out=2, broadcast_bytes=1).plan(text).sql
    assert over(spark, tables | {"r": tables["r"].limit(0)}, fan_out=2).sql(text).count() == 0
    assert "#blocks" not in over(spark, {"l": tables["l"], "r": spark.range(300).selectExpr("INT(id) AS k", "id AS y")}).plan("SELECT x, y FROM l, r WHERE l.k = r.k").sql


def test_pairs_are_dealt_evenly(spark, tmp_path):
    """A small file with few keys, one of them hot, makes 6 million pairs: no task has many more than its share."""
    duck = duckdb.connect()
    for name, key, nation, n in (("customer", "c_custkey", "c_nationkey", 20000), ("supplier", "s_suppkey", "s_nationkey", 1000)):
        duck.execute(f"COPY (SELECT i AS {key}, CASE WHEN i % 2 = 0 THEN 3 ELSE i % 25 END AS {nation} FROM range({n}) t(i)) TO '{tmp_path}/{name}.parquet'")
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    df = QUERIES["join_duplicates"](spark, str(tmp_path))
    parts = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    total = "count(*) AS n, sum(c_custkey) AS a, sum(s_suppkey) AS b, sum((c_custkey * 31 + s_suppkey) % 1009) AS h"
    want = duck.execute(f"SELECT {total} FROM ({ORACLE_SQL['join_duplicates']})").fetchone()
    assert tuple(df.selectExpr(*total.split(", ")).first()) == want and sum(parts) == want[0]
    assert len(parts) == 4 and max(parts) < 1.2 * want[0] / 4
