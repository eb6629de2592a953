"""The registered queries of the engine and their SQL twins.

Each query is a text in the dialect, run over the driver's tables; sums of doubles are rounded, since their last digits depend on
the order of summing."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowmill import operators as ops
from sparrowmill.errors import EngineError
from sparrowmill.plans import tools
from sparrowmill.plans.cardinality import CartesianProduct, Injected
from sparrowmill.session import Engine
from sparrowmill.sources import dsv, sinks
from sparrowmill.types import DATE, INT8, Type

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


#: Engines of queries whose results read their tables, and local folders; both go when the process ends.
_OPEN: list[Engine] = []


@atexit.register
def _clean() -> None:
    for e in _OPEN:
        try:
            e.close()
        except Exception:  # noqa: BLE001  the JVM may be gone already
            return


def engine(spark: SparkSession, sf_dir: str, text: str | None = None, **options) -> Engine:
    """An engine over the driver's tables, or over those that a text names."""
    e = Engine(spark, **options)
    _OPEN.append(e)
    for name in TABLES:
        if text is None or re.search(rf"\b{name}\b", text):
            e.register(name, spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))
    return e


def rounded(df: DataFrame, digits: int = 2) -> DataFrame:
    return df.select(*(F.round(F.col(f"`{c}`"), digits).alias(c) if k == "double" else F.col(f"`{c}`") for c, k in df.dtypes))


def add(name: str, text: str, oracle: str, round_: bool = False, **options) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = engine(spark, sf_dir, text, **options).sql(text)
        return rounded(df) if round_ else df

    QUERIES[name], ORACLE_SQL[name] = run, oracle


def query(oracle: str):
    def put(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, oracle
        return f

    return put


# ---------------------------------------------------------------- pricing and shipping reports

add(
    "tpch_q1",
    """SELECT l_returnflag, l_linestatus, SUM(l_quantity) AS sum_qty, SUM(l_extendedprice) AS sum_base_price,
              SUM(l_extendedprice * (1 - l_discount)) AS sum_disc_price, SUM(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS sum_charge,
              AVG(l_quantity) AS avg_qty, AVG(l_extendedprice) AS avg_price, AVG(l_discount) AS avg_disc, COUNT(*) AS count_order
       FROM lineitem WHERE l_shipdate <= d'1998-09-02 00:00:00'
       GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus""",
    """SELECT l_returnflag, l_linestatus, ROUND(SUM(l_quantity), 2) AS sum_qty, ROUND(SUM(l_extendedprice), 2) AS sum_base_price,
              ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, ROUND(SUM(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
              ROUND(AVG(l_quantity), 2) AS avg_qty, ROUND(AVG(l_extendedprice), 2) AS avg_price, ROUND(AVG(l_discount), 2) AS avg_disc, COUNT(*) AS count_order
       FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus ORDER BY 1, 2""",
    True,
)
add(
    "tpch_q3",
    """SELECT l_orderkey, SUM(l_extendedprice * (1 - l_discount)) AS revenue, o_orderdate
       FROM customer, orders, lineitem
       WHERE c_mktsegment = "BUILDING" AND c_custkey = o_custkey AND l_orderkey = o_orderkey
         AND o_orderdate < d'1998-03-15 00:00:00' AND l_shipdate > d'1998-03-15 00:00:00'
       GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10""",
    """SELECT l_orderkey, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate
       FROM customer, orders, lineitem
       WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey
         AND o_orderdate < TIMESTAMP '1998-03-15 00:00:00' AND l_shipdate > TIMESTAMP '1998-03-15 00:00:00'
       GROUP BY l_orderkey, o_orderdate ORDER BY SUM(l_extendedprice * (1 - l_discount)) DESC, o_orderdate, l_orderkey LIMIT 10""",
    True,
)
add(
    "tpch_q6",
    """SELECT SUM(l_extendedprice * l_discount) AS revenue FROM lineitem
       WHERE l_shipdate >= d'1996-01-01 00:00:00' AND l_shipdate < d'1997-01-01 00:00:00' AND l_discount > 0.04 AND l_discount < 0.08 AND l_quantity < 24""",
    """SELECT ROUND(SUM(l_extendedprice * l_discount), 2) AS revenue FROM lineitem
       WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01' AND l_discount > 0.04 AND l_discount < 0.08 AND l_quantity < 24""",
    True,
)
add(
    "tpch_q12",
    """SELECT l_linestatus, o_orderpriority, COUNT(*) AS n FROM orders, lineitem
       WHERE o_orderkey = l_orderkey AND (o_orderpriority = "1-URGENT" OR o_orderpriority = "2-HIGH") AND l_shipdate >= d'1997-01-01 00:00:00'
       GROUP BY l_linestatus, o_orderpriority ORDER BY l_linestatus, o_orderpriority""",
    """SELECT l_linestatus, o_orderpriority, COUNT(*) AS n FROM orders, lineitem
       WHERE o_orderkey = l_orderkey AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND l_shipdate >= TIMESTAMP '1997-01-01' GROUP BY 1, 2 ORDER BY 1, 2""",
)
add(
    "tpch_q14",
    """SELECT SUM(l_extendedprice * (1 - l_discount)) AS promo_revenue, COUNT(*) AS n FROM lineitem, part
       WHERE l_partkey = p_partkey AND p_type LIKE "PROMO%" AND l_shipdate >= d'1997-09-01 00:00:00' AND l_shipdate < d'1998-09-01 00:00:00'""",
    """SELECT ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS promo_revenue, COUNT(*) AS n FROM lineitem, part
       WHERE l_partkey = p_partkey AND p_type LIKE 'PROMO%' AND l_shipdate >= TIMESTAMP '1997-09-01' AND l_shipdate < TIMESTAMP '1998-09-01'""",
    True,
)

# ---------------------------------------------------------------- projections, literals and scalar expressions

add("select_star", "SELECT * FROM nation, region WHERE n_regionkey = r_regionkey", "SELECT nation.*, region.* FROM nation, region WHERE n_regionkey = r_regionkey")
add("select_star_and_more", "SELECT *, n_nationkey * 2 AS twice FROM nation", "SELECT *, n_nationkey * 2 AS twice FROM nation")
add("select_const", 'SELECT 1 AS a, 0x1F AS b, 017 AS c, 2.5 AS d, "x\\ty" AS e, TRUE AS f, d\'2020-02-29\' AS g, 3000000000 AS h', "SELECT 1 AS a, 31 AS b, 15 AS c, 2.5::DOUBLE AS d, 'x' || chr(9) || 'y' AS e, TRUE AS f, DATE '2020-02-29' AS g, 3000000000 AS h")
add("default_names", "SELECT 1, r_name, 2 FROM region", 'SELECT 1 AS "$const0", r_name, 2 AS "$const1" FROM region')
add("project_expr", "SELECT o_orderkey, o_totalprice * 2 + 1 AS a, -o_custkey AS b, (o_orderkey + o_custkey) * 3 AS c FROM orders", "SELECT o_orderkey, o_totalprice * 2 + 1 AS a, -o_custkey AS b, (o_orderkey + o_custkey) * 3 AS c FROM orders")
add("int_div_mod", "SELECT o_orderkey, o_orderkey / 7 AS q, o_orderkey % 7 AS r, (0 - o_orderkey) / 7 AS nq, (0 - o_orderkey) % 7 AS nr FROM orders", "SELECT o_orderkey, o_orderkey // 7 AS q, o_orderkey % 7 AS r, -(o_orderkey // 7) AS nq, -(o_orderkey % 7) AS nr FROM orders")
add("bitwise_not", "SELECT p_partkey, ~p_size AS inv FROM part", "SELECT p_partkey, ~p_size AS inv FROM part")
add("concat", 'SELECT n_nationkey, n_name .. "/" .. r_name AS full_name FROM nation, region WHERE n_regionkey = r_regionkey', "SELECT n_nationkey, n_name || '/' || r_name AS full_name FROM nation, region WHERE n_regionkey = r_regionkey")
add("isnull", "SELECT o_orderkey, ISNULL(o_orderstatus) AS a, ISNULL(NULL) AS b FROM orders", "SELECT o_orderkey, o_orderstatus IS NULL AS a, TRUE AS b FROM orders")
add("cast_int", "SELECT l_orderkey, l_linenumber, INT(l_quantity) AS q, INT(l_discount > 0.05) AS d FROM lineitem", "SELECT l_orderkey, l_linenumber, CAST(TRUNC(l_quantity) AS INTEGER) AS q, CAST(l_discount > 0.05 AS INTEGER) AS d FROM lineitem")
add("three_valued_logic", "SELECT n_nationkey, (NULL AND n_nationkey > 12) AS a, (NULL OR n_nationkey > 12) AS o, NOT (NULL = n_nationkey) AS n FROM nation", "SELECT n_nationkey, CASE WHEN n_nationkey > 12 THEN NULL ELSE FALSE END AS a, CASE WHEN n_nationkey > 12 THEN TRUE END AS o, CAST(NULL AS BOOLEAN) AS n FROM nation")

# ---------------------------------------------------------------- filters

add("filter_cnf", 'SELECT o_orderkey FROM orders WHERE NOT (o_totalprice < 100000 OR o_orderstatus = "F") AND (o_custkey > 500 OR o_orderkey % 2 = 0)', "SELECT o_orderkey FROM orders WHERE NOT (o_totalprice < 100000 OR o_orderstatus = 'F') AND (o_custkey > 500 OR o_orderkey % 2 = 0)")
add("filter_disjunction", 'SELECT o_orderkey FROM orders WHERE o_totalprice > 400000 OR o_orderpriority = "5-LOW" OR o_custkey = 7', "SELECT o_orderkey FROM orders WHERE o_totalprice > 400000 OR o_orderpriority = '5-LOW' OR o_custkey = 7")
add("filter_true", "SELECT r_name FROM region WHERE TRUE", "SELECT r_name FROM region WHERE TRUE")
add("filter_false", "SELECT r_name FROM region WHERE FALSE", "SELECT r_name FROM region WHERE FALSE")
add("filter_null_drops", "SELECT n_name FROM nation WHERE NULL OR n_nationkey < 5", "SELECT n_name FROM nation WHERE n_nationkey < 5")
add("filter_float", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount >= 0.07 AND l_tax != 0.02", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount >= 0.07::DOUBLE AND l_tax != 0.02::DOUBLE")
add("filter_date", "SELECT o_orderkey FROM orders WHERE o_orderdate >= d'1997-01-01 00:00:00' AND o_orderdate < d'1997-02-01 00:00:00'", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1997-02-01'")
add("filter_strcmp", 'SELECT p_partkey FROM part WHERE p_name < p_type AND p_brand >= "Brand#3"', "SELECT p_partkey FROM part WHERE p_name < p_type AND p_brand >= 'Brand#3'")
add("filter_boolean_equality", "SELECT o_orderkey FROM orders WHERE (o_custkey > 500) = (o_totalprice > 200000)", "SELECT o_orderkey FROM orders WHERE (o_custkey > 500) = (o_totalprice > 200000)")
for _name, _pattern in (("prefix", "PROMO%"), ("suffix", "%STEEL"), ("contains", "%AN%"), ("wildcard", "_R%_L"), ("complex", "%O_O%S%"), ("constant", "STANDARD"), ("escaped", "%\\%%")):
    add(f"like_{_name}", f'SELECT p_partkey, p_type FROM part WHERE p_type LIKE "{_pattern.replace(chr(92), chr(92) * 2)}"', f"SELECT p_partkey, p_type FROM part WHERE p_type LIKE '{_pattern}' ESCAPE '\\'")
add("like_expr", 'SELECT n_name FROM nation, region WHERE n_regionkey = r_regionkey AND n_name .. r_name LIKE "%_1%" .. r_name', "SELECT n_name FROM nation, region WHERE n_regionkey = r_regionkey AND (n_name || r_name) LIKE ('%_1%' || r_name)")
add("like_not", 'SELECT p_partkey FROM part WHERE NOT (p_type LIKE "%S%")', "SELECT p_partkey FROM part WHERE p_type NOT LIKE '%S%'")
add("index_point", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 77", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 77")
add("index_range", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 100 AND o_orderkey <= 420", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 100 AND o_orderkey <= 420")

# ---------------------------------------------------------------- joins

_JOIN = "SELECT o_orderkey, c_name FROM orders, customer WHERE o_custkey = c_custkey"
for _name, _hint in (("hash", "SHUFFLE_HASH"), ("merge", "MERGE"), ("broadcast", "BROADCAST")):
    add(f"join_{_name}", _JOIN, _JOIN, join_hint=_hint)
add("join_theta", "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation AS a, nation AS b WHERE a.n_nationkey < b.n_nationkey AND a.n_regionkey != b.n_regionkey", "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation AS a, nation AS b WHERE a.n_nationkey < b.n_nationkey AND a.n_regionkey != b.n_regionkey", join_hint="BROADCAST")
add("join_cross", "SELECT n_name, r_name FROM nation, region", "SELECT n_name, r_name FROM nation, region")
add("join_self", "SELECT a.s_suppkey AS x, b.s_suppkey AS y FROM supplier a, supplier b WHERE a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey", "SELECT a.s_suppkey AS x, b.s_suppkey AS y FROM supplier a, supplier b WHERE a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
_CHAIN = "SELECT r_name, COUNT(*) AS n FROM region, nation, customer, orders WHERE r_regionkey = n_regionkey AND n_nationkey = c_nationkey AND c_custkey = o_custkey GROUP BY r_name"
add("join_chain", _CHAIN, _CHAIN)
add("join_with_filter", 'SELECT o_orderkey, c_name FROM orders, customer WHERE o_custkey = c_custkey AND c_acctbal > 5000 AND o_orderstatus = "O"', "SELECT o_orderkey, c_name FROM orders, customer WHERE o_custkey = c_custkey AND c_acctbal > 5000 AND o_orderstatus = 'O'")
add("join_duplicates", "SELECT c_custkey, s_suppkey FROM customer, supplier WHERE c_nationkey = s_nationkey", "SELECT c_custkey, s_suppkey FROM customer, supplier WHERE c_nationkey = s_nationkey")
add("join_two_keys", "SELECT a.l_orderkey AS o, a.l_linenumber AS x, b.l_linenumber AS y FROM lineitem a, lineitem b WHERE a.l_orderkey = b.l_orderkey AND a.l_suppkey = b.l_suppkey AND a.l_linenumber < b.l_linenumber", "SELECT a.l_orderkey AS o, a.l_linenumber AS x, b.l_linenumber AS y FROM lineitem a, lineitem b WHERE a.l_orderkey = b.l_orderkey AND a.l_suppkey = b.l_suppkey AND a.l_linenumber < b.l_linenumber")
add("join_comparable_types", "SELECT l_orderkey, l_linenumber, n_name FROM lineitem, nation WHERE l_quantity = n_nationkey", "SELECT l_orderkey, l_linenumber, n_name FROM lineitem, nation WHERE l_quantity = n_nationkey")
add("join_strings", "SELECT a.o_orderkey AS x, b.r_regionkey AS y FROM orders a, region b WHERE a.o_orderstatus .. \"\" = b.r_name .. \"\" OR a.o_orderkey = b.r_regionkey", "SELECT a.o_orderkey AS x, b.r_regionkey AS y FROM orders a, region b WHERE a.o_orderstatus = b.r_name OR a.o_orderkey = b.r_regionkey")
add("join_with_order_by", "SELECT o_orderkey, c_name FROM orders, customer WHERE o_custkey = c_custkey ORDER BY c_name DESC, o_orderkey LIMIT 50", "SELECT o_orderkey, c_name FROM orders, customer WHERE o_custkey = c_custkey ORDER BY c_name DESC, o_orderkey LIMIT 50")
_GROUP_JOIN = "SELECT o_orderkey, COUNT(*) AS n, SUM(l_quantity) AS q FROM orders, lineitem WHERE o_orderkey = l_orderkey GROUP BY o_orderkey"
add("group_join", _GROUP_JOIN, _GROUP_JOIN.replace("SUM(l_quantity)", "ROUND(SUM(l_quantity), 2)"), True, join_hint="MERGE")
_ORDERED = "SELECT r_name, COUNT(*) AS n FROM lineitem, orders, customer, nation, region WHERE l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n_nationkey AND n_regionkey = r_regionkey GROUP BY r_name"
for _name in ("PEall", "DPsize", "DPsizeOpt", "DPsizeSub", "DPsub", "DPsubOpt", "DPccp", "IKKBZ", "LinearizedDP", "TDbasic", "TDMinCutAGaT", "GOO", "TDGOO", "HeuristicSearch"):
    add(f"join_order_{_name.lower()}", _ORDERED, _ORDERED, enumerator=_name)
add("join_order_injected", _CHAIN, _CHAIN, enumerator="DPccp", estimator=Injected({"main": [{"relations": ["region"], "size": 5}, {"relations": ["nation"], "size": 25}, {"relations": ["customer"], "size": 1500}, {"relations": ["orders"], "size": 15000}, {"relations": ["region", "nation"], "size": 25}, {"relations": ["nation", "customer"], "size": 1500}, {"relations": ["customer", "orders"], "size": 15000}, {"relations": ["region", "nation", "customer"], "size": 1500}, {"relations": ["nation", "customer", "orders"], "size": 15000}, {"relations": ["region", "nation", "customer", "orders"], "size": 15000}]}, "main"))


@query(_ORDERED)
def join_order_statistics(spark, sf_dir):
    """Join order from learned column statistics."""
    e = engine(spark, sf_dir, _ORDERED, enumerator="DPccp")
    e.execute("\\learn_spns;")
    return e.sql(_ORDERED)


# ---------------------------------------------------------------- subqueries

add("subquery_from", "SELECT q.k AS k, q.n + 1 AS m FROM (SELECT o_custkey AS k, COUNT(*) AS n FROM orders GROUP BY o_custkey) AS q WHERE q.n > 10", "SELECT k, n + 1 AS m FROM (SELECT o_custkey AS k, COUNT(*) AS n FROM orders GROUP BY o_custkey) AS q WHERE n > 10")
add("subquery_from_star", "SELECT * FROM (SELECT * FROM nation WHERE n_nationkey > 20) AS q, region WHERE q.n_regionkey = r_regionkey", "SELECT * FROM (SELECT * FROM nation WHERE n_nationkey > 20) AS q, region WHERE q.n_regionkey = r_regionkey")
add("subquery_where_scalar", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT AVG(o.o_totalprice) FROM orders AS o)", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) FROM orders)")
add("subquery_where_const", "SELECT r_name FROM region WHERE r_regionkey = (SELECT 1 + 1)", "SELECT r_name FROM region WHERE r_regionkey = 2")
add("subquery_having_scalar", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > (SELECT COUNT(*) FROM customer) / 100", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > (SELECT COUNT(*) FROM customer) // 100")
add("subquery_select_scalar", "SELECT n_name, (SELECT COUNT(*) FROM region) AS regions FROM nation", "SELECT n_name, (SELECT COUNT(*) FROM region) AS regions FROM nation")
add("subquery_correlated_max", "SELECT o_orderkey FROM orders WHERE o_totalprice = (SELECT MAX(i.o_totalprice) FROM orders AS i WHERE i.o_custkey = orders.o_custkey)", "SELECT o_orderkey FROM orders WHERE o_totalprice = (SELECT MAX(i.o_totalprice) FROM orders AS i WHERE i.o_custkey = orders.o_custkey)")
add("subquery_correlated_count", "SELECT c_custkey FROM customer WHERE (SELECT COUNT(*) FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000) = 2", "SELECT c_custkey FROM customer WHERE (SELECT COUNT(*) FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000) = 2")

# ---------------------------------------------------------------- grouping and aggregation

add("group_by_single", "SELECT o_orderstatus, COUNT(*) AS n, MIN(o_totalprice) AS lo, MAX(o_totalprice) AS hi, SUM(o_custkey) AS s FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, COUNT(*) AS n, MIN(o_totalprice) AS lo, MAX(o_totalprice) AS hi, CAST(SUM(o_custkey) AS BIGINT) AS s FROM orders GROUP BY o_orderstatus", True)
add("group_by_compound", "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY o_orderstatus, o_orderpriority", "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY o_orderstatus, o_orderpriority")
add("group_by_expr_alias", "SELECT bucket, COUNT(*) AS n FROM orders GROUP BY o_custkey % 10 AS bucket ORDER BY bucket", "SELECT o_custkey % 10 AS bucket, COUNT(*) AS n FROM orders GROUP BY o_custkey % 10 ORDER BY 1")
add("group_by_expr_repeated", "SELECT o_custkey % 10 + 1 AS b FROM orders GROUP BY o_custkey % 10", "SELECT DISTINCT o_custkey % 10 + 1 AS b FROM orders")
add("group_by_no_agg", "SELECT o_orderpriority FROM orders GROUP BY o_orderpriority", "SELECT DISTINCT o_orderpriority FROM orders")
add("group_by_const_item", "SELECT 1 AS one FROM orders GROUP BY o_orderstatus", "SELECT 1 AS one FROM orders GROUP BY o_orderstatus")
add("group_by_star", "SELECT * FROM orders GROUP BY o_orderstatus, o_orderpriority", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
add("group_by_primary_key", "SELECT o_orderkey, SUM(o_totalprice) AS s FROM orders GROUP BY o_orderkey", "SELECT o_orderkey, ROUND(SUM(o_totalprice), 2) AS s FROM orders GROUP BY o_orderkey", True)
add("agg_global", "SELECT COUNT(*) AS n, SUM(l_quantity) AS s, AVG(l_tax) AS a, MIN(l_linenumber) AS lo, MAX(l_extendedprice) AS hi FROM lineitem", "SELECT COUNT(*) AS n, ROUND(SUM(l_quantity), 2) AS s, ROUND(AVG(l_tax), 2) AS a, MIN(l_linenumber) AS lo, ROUND(MAX(l_extendedprice), 2) AS hi FROM lineitem", True)
add("agg_empty_input", "SELECT COUNT(*) AS n, SUM(r_regionkey) AS s, AVG(r_regionkey) AS a, MIN(r_regionkey) AS lo FROM region WHERE FALSE", "SELECT COUNT(*) AS n, CAST(SUM(r_regionkey) AS BIGINT) AS s, AVG(r_regionkey) AS a, MIN(r_regionkey) AS lo FROM region WHERE FALSE")
add("agg_expression", "SELECT SUM(l_extendedprice * (1 - l_discount)) / COUNT(*) AS mean FROM lineitem", "SELECT ROUND(SUM(l_extendedprice * (1 - l_discount)) / COUNT(*), 2) AS mean FROM lineitem", True)
add("agg_avg_is_double", "SELECT o_orderstatus, AVG(o_custkey) AS a FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, ROUND(AVG(o_custkey), 2) AS a FROM orders GROUP BY o_orderstatus", True)
add("having_grouped", "SELECT o_custkey, SUM(o_totalprice) AS s FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12 AND o_custkey % 2 = 0", "SELECT o_custkey, ROUND(SUM(o_totalprice), 2) AS s FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12 AND o_custkey % 2 = 0", True)
add("having_ungrouped", "SELECT COUNT(*) AS n FROM orders HAVING MAX(o_totalprice) > 1", "SELECT COUNT(*) AS n FROM orders HAVING MAX(o_totalprice) > 1")
add("having_const_select", "SELECT 42 AS x FROM orders HAVING COUNT(*) > 1", "SELECT 42 AS x FROM orders HAVING COUNT(*) > 1")

# ---------------------------------------------------------------- sorting and limits

add("order_asc", "SELECT c_custkey, c_name FROM customer ORDER BY c_name, c_custkey", "SELECT c_custkey, c_name FROM customer ORDER BY c_name, c_custkey")
add("order_desc", "SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey", "SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey")
add("order_expr", "SELECT o_orderkey FROM orders ORDER BY o_custkey % 7 + o_orderkey % 3 DESC, o_orderkey LIMIT 40", "SELECT o_orderkey FROM orders ORDER BY o_custkey % 7 + o_orderkey % 3 DESC, o_orderkey LIMIT 40")
add("order_non_result", "SELECT c_name FROM customer ORDER BY c_nationkey, c_custkey LIMIT 30", "SELECT c_name FROM customer ORDER BY c_nationkey, c_custkey LIMIT 30")
add("order_aggregate", "SELECT o_custkey FROM orders GROUP BY o_custkey ORDER BY COUNT(*) DESC, o_custkey LIMIT 20", "SELECT o_custkey FROM orders GROUP BY o_custkey ORDER BY COUNT(*) DESC, o_custkey LIMIT 20")
add("topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
add("limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 20", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 20")
add("limit_zero", "SELECT o_orderkey FROM orders LIMIT 0", "SELECT o_orderkey FROM orders LIMIT 0")


@query("SELECT k, v FROM (SELECT CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE n_nationkey END AS k, n_nationkey AS v FROM nation) ORDER BY k DESC NULLS FIRST, v LIMIT 8")
def order_nulls_first(spark, sf_dir):
    e = engine(spark, sf_dir)
    e.register("n", spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.when(F.col("n_nationkey") % 5 != 0, F.col("n_nationkey")).alias("k"), F.col("n_nationkey").alias("v")))
    return e.sql("SELECT k, v FROM n ORDER BY k DESC, v LIMIT 8")


_NULLED = "(SELECT CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_custkey % 10 END AS k, o_totalprice AS v FROM orders)"


def _nulled(spark, sf_dir) -> Engine:
    e = engine(spark, sf_dir)
    e.register("n", spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey") % 10).alias("k"), F.col("o_totalprice").alias("v")))
    return e


@query(f"SELECT COUNT(*) AS a, COUNT(k) AS b, ROUND(AVG(k), 2) AS c, CAST(SUM(k) AS BIGINT) AS d FROM {_NULLED}")
def count_star_vs_col(spark, sf_dir):
    return rounded(_nulled(spark, sf_dir).sql("SELECT COUNT(*) AS a, COUNT(k) AS b, AVG(k) AS c, SUM(k) AS d FROM n"))


@query(f"SELECT k, COUNT(*) AS n FROM {_NULLED} GROUP BY k")
def group_by_null_key(spark, sf_dir):
    return _nulled(spark, sf_dir).sql("SELECT k, COUNT(*) AS n FROM n GROUP BY k")


@query(f"SELECT k, n_name FROM {_NULLED}, nation WHERE k = n_nationkey")
def join_null_keys(spark, sf_dir):
    return _nulled(spark, sf_dir).sql("SELECT k, n_name FROM n, nation WHERE k = n_nationkey")


# ---------------------------------------------------------------- tables, files, versions, sinks, operators


def _folder(spark: SparkSession) -> str:
    """A folder for files of a query: shared on a cluster, temporary in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        root = tempfile.mkdtemp(prefix="sparrowmill-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
    return os.path.join(root, os.urandom(6).hex())


@query("SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_orderdate AS DATE) AS d FROM orders")
def dsv_roundtrip(spark, sf_dir):
    """Write a table as delimited text and read it back."""
    path = _folder(spark)
    dsv.write(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_orderdate").cast("date").alias("d")), path)
    return dsv.read(spark, path, [("o_orderkey", INT8), ("o_custkey", INT8), ("o_orderstatus", Type("char", 10)), ("d", DATE)], has_header=True)


@query("SELECT n_nationkey AS k, SUBSTRING(n_name, 1, 6) AS name FROM nation WHERE n_nationkey < 3 UNION ALL SELECT 100, 'abcdef' UNION ALL SELECT 101, NULL")
def ddl_insert(spark, sf_dir):
    """A table is created, appended to and queried; strings are cut to their length."""
    e = engine(spark, sf_dir)
    e.execute("CREATE TABLE t (k INT(4) PRIMARY KEY, name CHAR(6));")
    e.append("t", e.sql("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 3"))
    e.execute('INSERT INTO t VALUES (100, "abcdefgh"), (101, NULL);')
    return e.sql("SELECT k, name FROM t")


@query("SELECT * FROM (VALUES (1, 'old')) AS t(k, v)")
def mvcc_snapshot(spark, sf_dir):
    """What a table with row versions held at an earlier timestamp."""
    e = engine(spark, sf_dir, "", multi_versioning=True)
    e.execute('CREATE DATABASE d; USE d; CREATE TABLE t (k INT(4), v CHAR(3)); INSERT INTO t VALUES (1, "old");')
    then = e._clock
    e.execute('INSERT INTO t VALUES (2, "new");')
    return e.sql("SELECT * FROM t", snapshot=then)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey >= 10 AND o_custkey < 20")
def index_sorted_copy(spark, sf_dir):
    """A range condition answered from a copy that is sorted by its attribute."""
    e = engine(spark, sf_dir)
    e.execute("CREATE INDEX ix ON orders USING array (o_custkey);")
    e.build_index("ix", _folder(spark))
    return e.sql("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey >= 10 AND o_custkey < 20")


@query("SELECT CAST(r_regionkey AS VARCHAR) || ',\"' || r_name || '\"' AS row FROM region")
def sink_print(spark, sf_dir):
    return sinks.printed(engine(spark, sf_dir).sql("SELECT r_regionkey, r_name FROM region"))


@query("SELECT o_orderkey, COUNT(*) AS n FROM orders, lineitem WHERE o_orderkey = l_orderkey AND o_orderkey >= 50 GROUP BY o_orderkey")
def operators_api(spark, sf_dir):
    """The same algebra through DataFrame functions."""
    orders = ops.range_scan(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderkey", low=50)
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return ops.group_join(orders, lines, orders.o_orderkey == lines.l_orderkey, [orders.o_orderkey], [F.count(F.lit(1)).alias("n")])


@query("SELECT CAST(r_regionkey AS INTEGER) AS k, r_name AS v FROM region")
def pre_post_hooks(spark, sf_dir):
    """Hooks before and after planning."""
    from dataclasses import replace

    e = engine(spark, sf_dir)
    e.pre.append(lambda s: replace(s, limit=None))
    e.post.append(lambda df: df.withColumnsRenamed({"r_regionkey": "k", "r_name": "v"}))
    return e.sql("SELECT r_regionkey, r_name FROM region LIMIT 1")


# ---------------------------------------------------------------- decimals, names, shared aggregates, orders that are there already


def _money(spark, sf_dir, **options) -> Engine:
    """Orders with a price in decimals of two digits."""
    e = engine(spark, sf_dir, "", **options)
    price = F.col("o_totalprice").cast("decimal(12,2)")
    e.register("money", spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus", price.alias("price")))
    return e


_MONEY = "(SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_totalprice AS DECIMAL(12,2)) AS price FROM orders)"


@query(f"SELECT o_orderstatus, CAST(SUM(price) AS DECIMAL(19,2)) AS s, MIN(price) AS lo, MAX(price) AS hi, COUNT(price) AS n FROM {_MONEY} GROUP BY o_orderstatus")
def decimal_sum(spark, sf_dir):
    return _money(spark, sf_dir).sql("SELECT o_orderstatus, SUM(price) AS s, MIN(price) AS lo, MAX(price) AS hi, COUNT(price) AS n FROM money GROUP BY o_orderstatus")


@query(f"SELECT o_orderkey, CAST(price + 1 AS DOUBLE) AS a, CAST(price - price AS DOUBLE) AS b FROM {_MONEY} WHERE price > 150000.25")
def decimal_arithmetic(spark, sf_dir):
    df = _money(spark, sf_dir).sql("SELECT o_orderkey, price + 1 AS a, price - price AS b FROM money WHERE price > 150000.25")
    return df.select("o_orderkey", *(F.col(c).cast("double").alias(c) for c in "ab"))


add("duplicate_names", "SELECT n_name AS a, n_nationkey AS a, n_regionkey AS a FROM nation", 'SELECT n_name AS a, n_nationkey AS "a$1", n_regionkey AS "a$2" FROM nation')
add("agg_shared", "SELECT SUM(o_custkey) AS s, SUM(o_custkey) + COUNT(*) AS t, COUNT(*) AS n FROM orders HAVING COUNT(*) > 0 AND SUM(o_custkey) > 0", "SELECT CAST(SUM(o_custkey) AS BIGINT) AS s, CAST(SUM(o_custkey) + COUNT(*) AS BIGINT) AS t, COUNT(*) AS n FROM orders")
add("group_by_sorted", "SELECT k, COUNT(*) AS n FROM (SELECT o_custkey AS k FROM orders ORDER BY o_custkey) AS q GROUP BY k", "SELECT o_custkey AS k, COUNT(*) AS n FROM orders GROUP BY o_custkey")
add("order_sorted", "SELECT k FROM (SELECT n_nationkey AS k FROM nation ORDER BY n_nationkey) AS q ORDER BY k", "SELECT n_nationkey AS k FROM nation ORDER BY 1")
add("join_unique_build", "SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem, orders WHERE l_orderkey = o_orderkey AND o_custkey < 50", "SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem, orders WHERE l_orderkey = o_orderkey AND o_custkey < 50", join_hint="SHUFFLE_HASH")
add("join_build_side", "SELECT n_name, COUNT(*) AS n FROM nation, customer WHERE c_nationkey = n_nationkey GROUP BY n_name", "SELECT n_name, COUNT(*) AS n FROM nation, customer WHERE c_nationkey = n_nationkey GROUP BY n_name", join_hint="BROADCAST")
add("comments_and_empty_statements", "-- a comment\nSELECT r_name -- another\n FROM region", "SELECT r_name FROM region")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 90 AND o_orderkey < 140")
def index_learned(spark, sf_dir):
    """A range condition answered through an index of the method ``rmi``."""
    e = engine(spark, sf_dir, "orders")
    e.execute("CREATE INDEX learned ON orders USING rmi (o_orderkey);")
    e.build_index("learned", _folder(spark))
    return e.sql("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 90 AND o_orderkey < 140")


# ---------------------------------------------------------------- statements: every row says what came of one


def outcome(e: Engine, script: str) -> str:
    """``done``, or the kind of error that a script ends in."""
    try:
        e.execute(script)
    except EngineError as x:
        return type(x).__name__
    return "done"


def _outcomes(spark: SparkSession, e: Engine, *scripts: str) -> DataFrame:
    return spark.createDataFrame([(k, outcome(e, s)) for k, s in enumerate(scripts)], "step int, result string")


def _expected(*results: str) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"({k}, '{r}')" for k, r in enumerate(results)) + ") AS t(step, result)"


@query(_expected("done", "done", "SemanticError", "done", "SemanticError", "done", "done"))
def drop_database(spark, sf_dir):
    e = engine(spark, sf_dir, "")
    return _outcomes(spark, e, "CREATE DATABASE a;", "CREATE DATABASE b; USE a;", "DROP DATABASE a;", "DROP DATABASE b;", "DROP DATABASE b;", "DROP DATABASE IF EXISTS b;", "CREATE DATABASE b;")


@query(_expected("done", "SemanticError", "done", "SemanticError", "SemanticError", "done"))
def not_null_on_insert(spark, sf_dir):
    e = engine(spark, sf_dir, "region")
    create = "CREATE TABLE t (k INT(4) NOT NULL, s CHAR(3));"
    return _outcomes(spark, e, create, 'INSERT INTO t VALUES (NULL, "a");', "INSERT INTO t VALUES (1, NULL);", 'INSERT INTO t VALUES (1);', 'INSERT INTO t VALUES ("x", "y");', 'INSERT INTO t VALUES (2, "b");')


@query(_expected("done", "done", "SemanticError", "done", "SemanticError", "done"))
def drop_table(spark, sf_dir):
    e = engine(spark, sf_dir, "region")
    return _outcomes(spark, e, "CREATE TABLE t (k INT(4)); CREATE TABLE u (k INT(4));", "DROP TABLE t;", "SELECT k FROM t;", "DROP TABLE IF EXISTS t, u;", "DROP TABLE u;", "CREATE TABLE t (j INT(8)); SELECT j FROM t;")


@query(_expected("done", "SemanticError", "done", "SemanticError", "done", "done", "NotSupported"))
def drop_index(spark, sf_dir):
    e = engine(spark, sf_dir, "region")
    make = "CREATE INDEX i ON region (r_regionkey);"
    return _outcomes(spark, e, make, make, "DROP INDEX i;", "DROP INDEX i;", "DROP INDEX IF EXISTS i;", make, "CREATE UNIQUE INDEX j ON region (r_name);")


@query(_expected("NotSupported", "NotSupported", "SemanticError", "done"))
def parsed_only(spark, sf_dir):
    """UPDATE and DELETE are parsed, then refused; aggregates aren't allowed in WHERE."""
    e = engine(spark, sf_dir, "region")
    return _outcomes(spark, e, 'UPDATE region SET r_name = "x" WHERE r_regionkey = 1;', "DELETE FROM region WHERE r_regionkey = 1;", "SELECT r_name FROM region WHERE COUNT(*) > 1;", "; ; -- nothing\n;")


# ---------------------------------------------------------------- files and sinks


_IMPORTED = "SELECT n_nationkey AS k, SUBSTRING(n_name, 1, 8) AS name, n_regionkey % 2 = 0 AS even FROM nation"


def _imported(spark, sf_dir) -> tuple[Engine, str]:
    """An empty table and a delimited file with a header for it."""
    path = _folder(spark)
    dsv.write(spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), (F.col("n_regionkey") % 2 == 0).alias("even")), path)
    e = engine(spark, sf_dir, "region")
    e.execute("CREATE TABLE t (k INT(4) NOT NULL, name CHAR(8), even BOOL);")
    return e, path


@query(_IMPORTED)
def import_dsv(spark, sf_dir):
    e, path = _imported(spark, sf_dir)
    e.execute(f'IMPORT INTO t DSV "{path}" HAS HEADER SKIP HEADER;')
    return e.sql("SELECT k, name, even FROM t")


@query(_IMPORTED)
def load_csv(spark, sf_dir):
    e, path = _imported(spark, sf_dir)
    e.load_csv("t", path, has_header=True)
    return e.sql("SELECT k, name, even FROM t")


_KEYS = "SELECT n_nationkey AS k FROM nation ORDER BY 1"


@query(_KEYS)
def sink_callback(spark, sf_dir):
    """Rows handed to a callback."""
    seen: list = []
    sinks.each(engine(spark, sf_dir, _KEYS).sql("SELECT n_nationkey AS k FROM nation"), lambda r: seen.append((r["k"],)))
    return spark.createDataFrame(seen, "k int")


@query("SELECT COUNT(*) AS n FROM lineitem")
def sink_noop(spark, sf_dir):
    """Everything is computed, nothing kept; the rows are counted on the way."""
    return spark.createDataFrame([(sinks.dropped(engine(spark, sf_dir, "lineitem").sql("SELECT * FROM lineitem")),)], "n long")


@query("SELECT n_nationkey // 7 AS part, COUNT(*) AS n FROM nation GROUP BY 1")
def sink_windows(spark, sf_dir):
    """A result in windows of seven rows."""
    df = engine(spark, sf_dir, "nation").sql("SELECT n_nationkey FROM nation ORDER BY n_nationkey")
    return spark.createDataFrame([(k, len(w)) for k, w in enumerate(sinks.windows(df, 7))], "part int, n long")


@query("SELECT * FROM (VALUES ('0.5,100000,1e-05,9.9999997e-05,\"x\",TRUE'), ('-2.25,1e+16,123456.789,0,NULL,FALSE')) AS t(row)")
def sink_print_types(spark, sf_dir):
    """Floats and doubles with 8 and 16 significant digits at most."""
    data = [(0.5, 100000.0, 1e-05, 0.0001, "x", True), (-2.25, 1e16, 123456.789, 0.0, None, False)]
    return sinks.printed(spark.createDataFrame(data, "a float, b double, c double, d float, e string, f boolean"))


# ---------------------------------------------------------------- join ordering: searches, costs, statistics, tools

for _name, _search in (("zero", {"heuristic": "zero"}), ("beam", {"heuristic": "sum", "beam": 4}), ("weighted", {"heuristic": "GOO", "weight": 2.0}), ("topdown", {"heuristic": "sum", "vertex": "TopDown"}), ("lazy", {"heuristic": "GOO", "lazy": True}), ("pruned", {"heuristic": "sum", "prune": True}), ("anytime", {"heuristic": "GOO", "weight": 3.0, "anytime": 1000})):
    add(f"join_search_{_name}", _ORDERED, _ORDERED, enumerator="HeuristicSearch", search=_search)
add("join_order_products", _CHAIN, _CHAIN, enumerator="GOO", estimator=CartesianProduct())


@query(_CHAIN)
def join_cost_fitted(spark, sf_dir):
    """A join order by a cost that is fitted to measured times."""
    cost = tools.TrainedCost.fit([(10, 10, 10), (100, 10, 50), (1000, 10, 900), (10, 1000, 20), (500, 500, 2000)], [0.1, 0.3, 2.1, 1.2, 3.4])
    return engine(spark, sf_dir, _CHAIN, enumerator="DPccp", join_cost=cost).sql(_CHAIN)


@query("SELECT * FROM (VALUES ('region', 1), ('nation', 1), ('customer', 1), ('region, nation', 1), ('nation, customer', 1), ('region, nation, customer', 1)) AS t(names, n)")
def tool_cardinalities(spark, sf_dir):
    """Made-up sizes: one for each connected set of a chain of three."""
    got = tools.fake_cardinalities(["region", "nation", "customer"], {(0, 1), (1, 2)}, "main")["main"]
    return spark.createDataFrame([(", ".join(x["relations"]), 1) for x in got], "names string, n int")


@query("SELECT (SELECT COUNT(*) FROM region) + (SELECT COUNT(*) FROM nation) + (SELECT COUNT(*) FROM nation WHERE n_regionkey IS NOT NULL) AS n")
def tool_slices(spark, sf_dir):
    """A counting query for each connected part of a query; their sum."""
    text = "SELECT n.n_name FROM region AS r, nation AS n WHERE r.r_regionkey = n.n_regionkey"
    e = engine(spark, sf_dir, text)
    parts = [e.sql(s.rstrip(";").replace("COUNT(*)", "COUNT(*) AS n")) for s in tools.slices(e._one(text))]
    total = parts[0]
    for p in parts[1:]:
        total = total.unionByName(p)
    return total.agg(F.sum("n").alias("n"))


@query(_CHAIN)
def graph_to_sql(spark, sf_dir):
    """The planned SQL of a query, run by Spark alone."""
    return spark.sql(engine(spark, sf_dir, _CHAIN, enumerator="DPccp").explain(_CHAIN, "graph2sql"))


@query("SELECT * FROM (VALUES ('graph', TRUE), ('graphdot', TRUE), ('graph2sql', TRUE), ('formatted', TRUE)) AS t(mode, given)")
def explain_modes(spark, sf_dir):
    """What a shell shows of a query: its graph, as text and as a drawing, its SQL and Spark's plan."""
    e, marks = engine(spark, sf_dir, _CHAIN), {"graph": "nation", "graphdot": "graph", "graph2sql": "SELECT", "formatted": "Scan parquet"}
    return spark.createDataFrame([(m, mark in e.explain(_CHAIN, m)) for m, mark in marks.items()], "mode string, given boolean")


@query("SELECT 20 AS n, 20 AS stamps")
def statements_are_serial(spark, sf_dir):
    """Statements of several threads: each has a timestamp of its own, and none is lost."""
    from concurrent.futures import ThreadPoolExecutor

    e = engine(spark, sf_dir, "region")
    before = e._clock
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda k: e.execute(f"SELECT {k} AS k;"), range(20)))
    return spark.createDataFrame([(len([x for x in e.times if x[0] == "Select"]), e._clock - before)], "n int, stamps int")
