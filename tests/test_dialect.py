"""The dialect's lexer, parser and analyser: what is accepted, what is refused, and how names and types come out."""

import pytest

from sparrowmill import types as t
from sparrowmill.errors import EngineError, LexError, NotSupported, ParseError, SemanticError
from sparrowmill.plans import cnf
from sparrowmill.queries import engine
from sparrowmill.session import Engine
from sparrowmill.sources import dsv
from sparrowmill.sql.lexer import tokens
from sparrowmill.sql.parser import parse
from sparrowmill.types import Type


def one(text):
    return tokens(text)[0]


@pytest.mark.parametrize("text,value", [("42", 42), ("017", 15), ("0x1F", 31), ("1.5", 1.5), (".5", 0.5), ("1e3", 1000.0), ("0x1.8p1", 3.0), ("0x1.8", 1.5), ("0x0.", 0.0), ("0x.8", 0.5), ("0x1p3", 8.0), ('"a\\"b\\\\c\\n"', 'a"b\\c\n')])
def test_literals(text, value):
    assert one(text).value == value


@pytest.mark.parametrize("text,kind", [("d'2020-01-31'", "date"), ("d'-0044-03-15'", "date"), ("d'2020-01-31 10:11:12'", "datetime"), ("SELECT", "keyword"), ("select", "name"), ("..", "op"), ("\\learn_spns", "instruction")])
def test_kinds(text, kind):
    assert one(text).kind == kind


@pytest.mark.parametrize("text", ['"open', '"bad \\q"', "d'2020-1-1'", "d'2020-01-01", "12ab", "08", "?", "'x'"])
def test_lexical_errors(text):
    with pytest.raises(LexError):
        tokens(text)


def test_comments_and_positions():
    got = tokens("-- a comment\n  SELECT")
    assert got[0].pos == (2, 3)


@pytest.mark.parametrize("text,shape", [
    ("1 + 2 * 3", "(1 + (2 * 3))"), ("1 - 2 - 3", "((1 - 2) - 3)"), ("NOT a = b AND c", "(NOT (a = b) AND c)"), ("a OR b AND c", "(a OR (b AND c))"),
    ("-a * b", "(-a * b)"), ('a .. b LIKE "x"', '((a .. b) LIKE "x")'), ("a + b .. c", "((a + b) .. c)"), ("~(a + b)", "~(a + b)"),
])
def test_precedence(text, shape):
    assert str(parse(f"SELECT {text};")[0].items[0][0]) == shape


@pytest.mark.parametrize("text", ["SELECT;", "SELECT 1", "SELECT 1 FROM;", "SELECT a FROM (SELECT 1);", "SELECT a b c FROM t;", "CREATE TABLE t ();", "CREATE TABLE t (a INT(3));", "DROP t;", "INSERT INTO t (1);", 'IMPORT INTO t CSV "x";', 'IMPORT INTO t DSV "x" DELIMITER "ab";', "SELECT a FROM t LIMIT x;", "SELECT a FROM t ORDER a;", "CREATE TABLE t (a CHAR(0));"])
def test_syntax_errors(text):
    with pytest.raises(ParseError):
        parse(text)


@pytest.fixture(scope="module")
def e(spark, sf):
    x = engine(spark, sf)
    yield x
    x.close()


@pytest.mark.parametrize("text", [
    "SELECT x FROM nation", "SELECT n_name FROM nation, nation", "SELECT a.n_name FROM nation", "SELECT n_nationkey FROM nation a, nation b", "SELECT n_name FROM missing",
    "SELECT n_name + 1 FROM nation", "SELECT TRUE < FALSE", "SELECT NOT 1", "SELECT 1 AND TRUE", 'SELECT 1 = "a"', 'SELECT "a" .. 1', "SELECT 1 LIKE 2", "SELECT ~1.5", "SELECT d'2020-01-01' = d'2020-01-01 00:00:00'",
    "SELECT SUM(n_nationkey), n_name FROM nation", "SELECT n_name FROM nation GROUP BY n_regionkey", "SELECT n_name FROM nation WHERE COUNT(*) > 1", "SELECT COUNT(*) FROM nation GROUP BY COUNT(*)", "SELECT SUM(COUNT(*)) FROM nation",
    "SELECT 1 FROM nation GROUP BY 1", "SELECT n_name FROM nation ORDER BY 1", "SELECT n_name FROM nation HAVING n_name = \"A\"", "SELECT COUNT(*) FROM nation HAVING COUNT(*)", "SELECT SUM(n_name) FROM nation", "SELECT AVG(n_name) FROM nation", "SELECT FOO(1)", "SELECT SUM(*) FROM nation",
    "SELECT n_name FROM nation WHERE n_nationkey", "SELECT * ", "SELECT (SELECT n_name FROM nation)", "SELECT (SELECT 1, 2)", "SELECT n_name FROM nation WHERE n_nationkey = (SELECT COUNT(*) FROM nation)",
    "SELECT q.a FROM region, (SELECT n_name AS a FROM nation WHERE n_regionkey = r_regionkey) AS q", "SELECT 99999999999999999999", "SELECT d'2021-02-29'", "SELECT d'0000-01-01'", "SELECT ISNULL(1, 2)", 'SELECT INT("a")',
    "SELECT n_name AS a, n_nationkey AS a FROM nation ORDER BY a", "SELECT * FROM (SELECT n_name AS a, n_nationkey AS a FROM nation) AS q", "SELECT q.a FROM (SELECT n_name AS a, n_nationkey AS a FROM nation) AS q", "SELECT * FROM nation a, nation b GROUP BY a.n_name, b.n_name",
])
def test_semantic_errors(e, text):
    with pytest.raises((SemanticError, ParseError)):
        e.plan(text)


@pytest.mark.parametrize("text,names", [("SELECT 1, n_name, 2 FROM nation", ["$const0", "n_name", "$const1"]), ("SELECT n_name, n_name FROM nation", ["n_name", "n_name$1"]), ("SELECT n_nationkey + 1 FROM nation", ["(n_nationkey + 1)"]), ("SELECT * FROM region", ["r_regionkey", "r_name"]), ("SELECT COUNT(*) FROM nation", ["COUNT(*)"])])
def test_result_names(e, text, names):
    assert [n for n, _ in e.plan(text).fields] == names == e.sql(text).columns


@pytest.mark.parametrize("a,b,joined", [(t.INT1, t.INT4, t.INT4), (t.INT4, t.FLOAT, t.FLOAT), (t.INT8, t.FLOAT, t.DOUBLE), (t.FLOAT, t.DOUBLE, t.DOUBLE), (t.decimal(10, 2), t.decimal(12, 4), t.decimal(12, 4))])
def test_arithmetic_join(a, b, joined):
    assert t.arithmetic_join(a, b) == joined == t.arithmetic_join(b, a)


def test_subqueries_of_from_may_use_outer_aliases(e):
    assert e.sql("SELECT * FROM region, (SELECT * FROM region) AS b WHERE region.r_name = b.r_name").count() == 5
    assert e.sql("SELECT b FROM (SELECT n_name AS a, n_name AS a, n_nationkey AS b FROM nation) AS q").count() == 25


def test_planned_types_are_the_results(e):
    text = "SELECT n_nationkey / 2 AS a, n_nationkey + 3000000000 AS b, SUM(n_nationkey) AS c, AVG(n_nationkey) AS d, COUNT(*) AS f FROM nation GROUP BY n_nationkey"
    assert [t.from_spark(f.dataType) for f in e.sql(text).schema.fields] == [ty for _, ty in e.plan(text).fields]


def test_normal_form():
    (s,) = parse("SELECT 1 FROM t WHERE NOT (a = 1 OR b < 2) AND (c OR d AND e);")
    assert [[str(x) for x in c] for c in cnf.clauses(s.where)] == [["(a != 1)"], ["(b >= 2)"], ["c", "d"], ["c", "e"]]


def test_statements_that_are_parsed_only(spark):
    e = Engine(spark)
    e.execute("CREATE DATABASE d; USE d; CREATE TABLE t (a INT(4));")
    for text in ("UPDATE t SET a = 1 WHERE a = 2;", "DELETE FROM t WHERE a = 1;"):
        with pytest.raises(NotSupported):
            e.execute(text)
    e.close()


def test_integer_semantics(spark):
    row = Engine(spark).sql("SELECT 7 / 2 AS a, (0 - 7) / 2 AS b, (0 - 7) % 3 AS c, 7 / 2.0 AS d").first()
    assert tuple(row) == (3, -3, -1, 3.5)


def test_overflow_is_an_error(spark):
    with pytest.raises(Exception, match="(?i)overflow"):
        Engine(spark).sql("SELECT 2147483647 + 1 AS a").collect()


def test_bad_like_escape_fails(e):
    with pytest.raises(Exception, match="(?i)escape|INVALID_FORMAT"):
        e.sql('SELECT n_name LIKE "a\\\\b" AS x FROM nation').collect()


def test_dates_before_christ(spark):
    assert Engine(spark).sql("SELECT d'-0044-03-15' < d'0001-01-01' AS a").first().a is True


def test_words_that_are_no_keywords(spark):
    e = Engine(spark)
    e.register("t", spark.createDataFrame([(1, 2)], "ALL int, COMMIT int"))
    assert e.sql("SELECT ALL, COMMIT AS ADD FROM t").columns == ["ALL", "ADD"]
    with pytest.raises(EngineError):
        e.sql("SELECT CASCADE FROM t")
    e.close()


def test_control_characters_in_delimited_files(spark, tmp_path):
    path = tmp_path / "f.csv"
    path.write_bytes(b'a,b\n\x01,""\n"\x01x",\n')
    got = dsv.read(spark, str(path), [("a", Type("char", 5)), ("b", Type("char", 5))], has_header=True).collect()
    assert [tuple(r) for r in got] == [("\x01", ""), ("\x01x", None)]
