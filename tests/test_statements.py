"""Definitions, inserts, imports, row versions, indexes, hooks, sinks and explain."""

import datetime
import decimal

import pytest

from sparrowmill.errors import NotSupported, SemanticError
from sparrowmill.queries import engine
from sparrowmill.session import Engine
from sparrowmill.sources import dsv, sinks
from sparrowmill.types import BOOL, DATE, DATETIME, DOUBLE, FLOAT, INT4, Type, decimal as dec


@pytest.fixture
def e(spark):
    x = Engine(spark)
    x.execute("CREATE DATABASE d; USE d;")
    yield x
    x.close()


def test_databases(spark):
    e = Engine(spark)
    e.execute("CREATE DATABASE a; CREATE DATABASE b; USE a;")
    for bad in ("CREATE DATABASE a;", "DROP DATABASE a;", "DROP DATABASE IF EXISTS a;", "DROP DATABASE c;", "USE c;"):
        with pytest.raises(SemanticError):
            e.execute(bad)
    e.execute("DROP DATABASE b; DROP DATABASE IF EXISTS b;")
    with pytest.raises(SemanticError):
        Engine(spark).execute("CREATE TABLE t (a INT(4));")


def test_tables_and_inserts(e):
    e.execute("""CREATE TABLE p (k INT(4) PRIMARY KEY);
                 CREATE TABLE t (a INT(2) NOT NULL, b CHAR(3) UNIQUE, c DECIMAL(10, 2), d DATE, f DATETIME, g BOOL CHECK (g = TRUE), h INT(4) REFERENCES p (k));
                 INSERT INTO t VALUES (1, "abcdef", 1.25, d'2020-02-29', d'2020-01-02 03:04:05', TRUE, 7), (2, NULL, DEFAULT, NULL, NULL, NULL, NULL);""")
    assert e.sql("SELECT * FROM t ORDER BY a").collect() == [(1, "abc", decimal.Decimal("1.25"), datetime.date(2020, 2, 29), datetime.datetime(2020, 1, 2, 3, 4, 5), True, 7), (2, None, None, None, None, None, None)]
    for bad in ('INSERT INTO t VALUES (NULL, "a", 1, NULL, NULL, NULL, NULL);', "INSERT INTO t VALUES (1);", 'INSERT INTO t VALUES ("x", "a", 1, NULL, NULL, NULL, NULL);', "CREATE TABLE t (a INT(4));", "CREATE TABLE u (a INT(4), a INT(4));", "CREATE TABLE u (a INT(4) PRIMARY KEY, b INT(4) PRIMARY KEY);", "CREATE TABLE u (a INT(4) REFERENCES t (zz));", "CREATE TABLE u (a INT(4) CHECK (a + 1));", "DROP TABLE zz;"):
        with pytest.raises(SemanticError):
            e.execute(bad)
    e.execute("DROP TABLE t, p; DROP TABLE IF EXISTS t;")
    with pytest.raises(SemanticError):
        e.sql("SELECT * FROM t")


def test_append(e):
    e.execute("CREATE TABLE t (a INT(4), b CHAR(2));")
    e.append("t", [(1, "xyz"), (None, None)])
    e.append("t", e.sql("SELECT a, b FROM t"))
    assert sorted(e.sql("SELECT * FROM t").collect(), key=str) == sorted([(1, "xy"), (None, None)] * 2, key=str)


def test_indexes(e, tmp_path):
    e.execute("CREATE TABLE t (a INT(4), s CHAR(3)); INSERT INTO t VALUES (1, \"a\"), (5, \"b\"), (9, \"c\"); CREATE INDEX i ON t USING rmi (a); CREATE INDEX IF NOT EXISTS i ON t (a); CREATE INDEX j ON t (s);")
    for bad, kind in (("CREATE UNIQUE INDEX u ON t (a);", NotSupported), ("CREATE INDEX u ON t (a, s);", NotSupported), ("CREATE INDEX u ON t ((a + 1));", NotSupported), ("CREATE INDEX ON t (a);", SemanticError), ("CREATE INDEX i ON t (a);", SemanticError), ("CREATE INDEX u ON t USING tree (a);", SemanticError), ("CREATE INDEX u ON t USING rmi (s);", SemanticError), ("CREATE INDEX u ON t (zz);", SemanticError), ("DROP INDEX zz;", SemanticError)):
        with pytest.raises(kind):
            e.execute(bad)
    e.build_index("i", str(tmp_path / "i"))
    assert "index_i" in e.plan("SELECT s FROM t WHERE a > 2 AND a <= 9").sql
    assert "index_i" not in e.plan("SELECT s FROM t WHERE a + 1 > 2").sql
    assert {r.s for r in e.sql("SELECT s FROM t WHERE a > 2 AND a <= 9").collect()} == {"b", "c"}
    e.execute('INSERT INTO t VALUES (7, "d");')  # the copy is out of date now
    assert "index_i" not in e.plan("SELECT s FROM t WHERE a > 2").sql
    assert e.sql("SELECT s FROM t WHERE a = 7").collect() == [("d",)]
    e.execute("DROP INDEX i, j; DROP INDEX IF EXISTS i;")


def test_row_versions(spark):
    e = Engine(spark, multi_versioning=True)
    e.execute('CREATE DATABASE d; USE d; CREATE TABLE t (a INT(4)); INSERT INTO t VALUES (1);')
    then = e._clock
    e.execute("INSERT INTO t VALUES (2);")
    assert e.sql("SELECT * FROM t").columns == ["a"]
    assert e.sql("SELECT COUNT(*) AS n FROM t").first().n == 2
    assert e.sql("SELECT * FROM t", snapshot=then).collect() == [(1,)]
    assert e.sql("SELECT * FROM t", snapshot=0).collect() == []
    e.close()


COLUMNS = [("i", INT4), ("s", Type("char", 4)), ("b", BOOL), ("d", DATE), ("t", DATETIME), ("m", dec(6, 2)), ("f", FLOAT), ("x", DOUBLE)]


def test_import_cells(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('1,"a,bcdef",TRUE,2020-01-31,2020-01-31 10:11:12,3.999,1e99,2.5\n2x,,true,2020-02-30,x,4.x,y,z\n,"",FALSE,-0044-03-15,,-1.239,-0.5,\n1,2\n')
    got = dsv.read(spark, str(p), COLUMNS).selectExpr("i", "s", "b", "cast(d as string) d", "cast(t as string) t", "m", "cast(f as double) f", "x").collect()
    assert [tuple(r) for r in got] == [
        (1, "a,bc", True, "2020-01-31", "2020-01-31 10:11:12", decimal.Decimal("3.99"), pytest.approx(3.4028234663852886e38), 2.5),
        (None, None, None, None, None, None, None, None),
        (None, "", False, "-0044-03-15", None, decimal.Decimal("-1.23"), -0.5, None),
    ]


def test_import_headers_rows_and_quotes(e, tmp_path):
    p = tmp_path / "h.csv"
    p.write_text("zz|b|a\n9|'it''s'|1\n8|'x'|2\n7|y|3\n")
    e.execute(f"""CREATE TABLE t (a INT(4), b CHAR(10)); IMPORT INTO t DSV "{p}" ROWS 2 DELIMITER "|" ESCAPE "'" QUOTE "'" HAS HEADER;""")
    assert e.sql("SELECT * FROM t ORDER BY a").collect() == [(1, "it's"), (2, "x")]
    q = tmp_path / "q.csv"
    q.write_text("id,name\n5,v\n")
    e.load_csv("t", str(q), skip_header=True)
    assert e.sql("SELECT b FROM t WHERE a = 5").collect() == [("v",)]


def test_dsv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a"b', True), (2, None, None), (3, "", False), (4, "x,y\\z", True)], "a int, b string, c boolean")
    dsv.write(df, str(tmp_path / "o"))
    assert sorted(dsv.read(spark, str(tmp_path / "o"), [("a", INT4), ("b", Type("varchar")), ("c", BOOL)], has_header=True).collect()) == sorted(df.collect())


def test_sinks(spark, sf):
    e = engine(spark, sf)
    df = e.sql('SELECT r_regionkey, r_name, NULL AS n, TRUE AS b FROM region ORDER BY r_regionkey')
    assert list(sinks.lines(df))[0] == '0,"AFRICA",NULL,TRUE'
    seen = []
    assert sinks.each(df, seen.append) == 5 and len(seen) == 5
    assert [len(w) for w in sinks.windows(df, 2)] == [2, 2, 1]
    assert sinks.dropped(df) == 5


def test_explain_and_pushdown(spark, sf):
    e = engine(spark, sf)
    q = "SELECT o_orderkey FROM orders, customer WHERE o_custkey = c_custkey AND o_orderkey > 100"
    plan = e.explain(q)
    assert "PushedFilters" in plan and "GreaterThan(o_orderkey,100)" in plan and "o_totalprice" not in plan.split("ReadSchema")[1].split("\n")[0]
    assert "INNER JOIN" in e.explain(q, "graph2sql") and "--" in e.explain(q, "graphdot") and "joins" in e.explain(q, "graph")
    e.sql(q)
    assert e.times


def test_group_join_needs_no_third_exchange(spark, sf):
    e = engine(spark, sf, join_hint="MERGE")
    df = e.sql("SELECT o_orderkey, COUNT(*) AS n FROM orders, lineitem WHERE o_orderkey = l_orderkey GROUP BY o_orderkey")
    assert df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple").count("Exchange hashpartitioning") == 2


def test_topk_is_not_a_full_sort(spark, sf):
    assert "TakeOrderedAndProject" in engine(spark, sf).explain("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC LIMIT 5", "simple")


def test_streams(spark, sf, tmp_path):
    from sparrowmill.streaming import continuous

    e = engine(spark, sf)
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    e.register("stream", spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf))
    got = []
    q = continuous(e, "SELECT event_type, COUNT(*) AS n FROM stream GROUP BY event_type", lambda df, k: got.append({r.event_type: r.n for r in df.collect()}), str(tmp_path / "c"))
    q.awaitTermination(120)
    assert got[-1] == {r.event_type: r.n for r in e.sql("SELECT event_type, COUNT(*) AS n FROM events GROUP BY event_type").collect()}
