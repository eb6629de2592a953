"""The engine: databases, tables, indexes and statements over a Spark session."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparrowmill import types as t
from sparrowmill.errors import EngineError, NotSupported, SemanticError
from sparrowmill.plans import dumps
from sparrowmill.plans.cardinality import CartesianProduct, Statistics
from sparrowmill.sources import dsv
from sparrowmill.sql import ast
from sparrowmill.sql.binder import Binder, Options, Plan, TableInfo, ident
from sparrowmill.sql.parser import parse
from sparrowmill.types import Type

#: Hidden columns of tables with row versions.
TS_BEGIN, TS_END = "$ts_begin", "$ts_end"
INDEX_METHODS = ("DEFAULT", "array", "rmi")


@dataclass
class Index:
    name: str
    table: str
    attribute: str
    method: str
    view: str | None = None  # of the sorted copy, if there is one that is up to date


@dataclass
class Table:
    name: str
    columns: dict[str, ast.ColumnDef]
    relation: str  # Spark's name of the table or view, quoted
    managed: bool
    versions: bool = False


@dataclass
class Database:
    name: str
    tables: dict[str, Table] = field(default_factory=dict)
    indexes: dict[str, Index] = field(default_factory=dict)
    statistics: Statistics = field(default_factory=Statistics)


class Engine:
    """Runs the dialect on a Spark session.  Statements are serial; every one gets a timestamp of its own.

    ``enumerator``: a join-order enumerator by name, or None to leave the order to Catalyst.  ``join_hint``: a Spark join hint for
    queries of several tables; it names the smallest, and no table above ``broadcast_bytes`` is broadcast.  ``estimator``: of sizes, for
    the enumerator; by default from statistics, where they were learned.  ``search``: options of the enumerator ``HeuristicSearch``
    (heuristic, weight, beam, vertex, lazy, prune, anytime).  ``fan_out``: two tables without a hint, the smaller of which has so many
    rows a key, are joined block by block; planning counts the rows of its keys.  ``join_cost``: cost of a join for the enumerator, say a fitted one.  ``compat_decimal``: decimal results are cut to the joined type.  ``multi_versioning``: tables that are
    created from now on keep row versions.  Hooks: ``pre`` callables get and return a parsed SELECT, ``post`` ones a DataFrame.
    """

    def __init__(self, spark: SparkSession, enumerator: str | None = None, estimator: CartesianProduct | None = None, join_hint: str | None = None, compat_decimal: bool = False, multi_versioning: bool = False, search: dict | None = None, join_cost: Callable[[float, float, float], float] | None = None, broadcast_bytes: int = 64 << 20, fan_out: int = 64) -> None:
        self.spark, self.multi_versioning = spark, multi_versioning
        self.options = Options(enumerator, estimator or Statistics(), join_hint, compat_decimal, search, join_cost, broadcast_bytes, fan_out)
        self.databases: dict[str, Database] = {}
        self.current: Database | None = None
        self.pre: list[Callable[[ast.Select], ast.Select]] = []
        self.post: list[Callable[[DataFrame], DataFrame]] = []
        self.instructions: dict[str, Callable] = {"learn_spns": lambda e, args: e.learn_statistics()}
        self.times: list[tuple[str, float]] = []
        self._lock = threading.RLock()
        self._uid = uuid.uuid4().hex[:10]
        self._clock = 0

    # ---- databases and tables

    @property
    def db(self) -> Database:
        if self.current is None:
            raise SemanticError("no database is in use")
        return self.current

    def create_database(self, name: str, use: bool = False) -> None:
        if name in self.databases:
            raise SemanticError(f"database {name} exists already")
        self.databases[name] = Database(name)
        if use:
            self.current = self.databases[name]

    def _space(self, db: Database) -> str:
        """Spark's database for the managed tables of one of ours; made when it is first needed."""
        name = f"sparrowmill_{db.name}_{self._uid}".lower()
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS {ident(name)}")
        return name

    def table(self, name: str) -> Table:
        if name not in self.db.tables:
            raise SemanticError(f"there is no table {name} in {self.db.name}")
        return self.db.tables[name]

    def register(self, name: str, df: DataFrame) -> None:
        """Make a DataFrame a table of the current database; columns of types that the dialect lacks are left out."""
        if self.current is None:
            self.create_database("main", use=True)
        cols = {}
        for f in df.schema.fields:
            try:
                cols[f.name] = ast.ColumnDef(f.name, t.from_spark(f.dataType), not_null=not f.nullable)
            except SemanticError:
                continue
        view = f"sparrowmill_{self._uid}_{self.db.name}_{name}"
        df.select(*(F.col(ident(c)) for c in cols)).createOrReplaceTempView(view)
        self.db.tables[name] = Table(name, cols, ident(view), False)

    def _info(self, name: str, at: int) -> TableInfo:
        table, db = self.table(name), self.db

        def relation(conditions: list[tuple[str, str, object]]) -> str:
            for attr, op, _ in conditions:
                for ix in db.indexes.values():
                    if ix.table == name and ix.attribute == attr and ix.view and op != "!=":
                        return ident(ix.view)
            return self._visible(table, at)

        def size() -> float:
            return float(self.spark.sql(f"SELECT * FROM {table.relation}")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())

        def rows() -> float:
            return max(1.0, size() / (8.0 * max(1, len(table.columns))))

        def first(sql: str) -> tuple | None:
            df = self.spark.sql(sql)
            return None if df.isStreaming else df.first()

        return TableInfo({n: c.type for n, c in table.columns.items()}, relation, rows, size, first)

    def _visible(self, table: Table, at: int) -> str:
        if not table.versions:
            return table.relation
        cols = ", ".join(ident(c) for c in table.columns)
        return f"(SELECT {cols} FROM {table.relation} WHERE {ident(TS_BEGIN)} <= {at} AND ({ident(TS_END)} > {at} OR {ident(TS_END)} = -1))"

    # ---- queries

    def plan(self, text: str | ast.Select, snapshot: int | None = None) -> Plan:
        """The plan of one SELECT: Spark SQL, result columns and query graph."""
        select = text if isinstance(text, ast.Select) else self._one(text)
        if not isinstance(select, ast.Select):
            raise SemanticError("only a SELECT has a plan")
        for hook in self.pre:
            select = hook(select)
        at = self._clock if snapshot is None else snapshot
        self.options.slices = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return Binder(lambda n: self._info(n, at), self.options).select(select)

    def sql(self, text: str | ast.Select, snapshot: int | None = None) -> DataFrame:
        """The result of one SELECT, lazily.  ``snapshot``: an earlier timestamp, for tables with row versions."""
        with self._lock:
            began = time.perf_counter()
            df = self.spark.sql(self.plan(text, snapshot).sql)
            for hook in self.post:
                df = hook(df)
            self.times.append(("plan", time.perf_counter() - began))
            return df

    def _one(self, text: str):
        got = parse(text if text.rstrip().endswith(";") else text + ";")
        if len(got) != 1:
            raise SemanticError(f"expected one statement, got {len(got)}")
        return got[0]

    def execute(self, script: str) -> list[DataFrame]:
        """All statements of a script, in order; returns the results of its SELECTs."""
        return [r for s in parse(script) if (r := self.run(s)) is not None]

    def execute_file(self, path: str) -> list[DataFrame]:
        with open(path) as f:
            return self.execute(f.read())

    def run(self, s) -> DataFrame | None:
        """One parsed statement."""
        with self._lock:
            self._clock += 1
            began = time.perf_counter()
            try:
                return self._run(s)
            finally:
                self.times.append((type(s).__name__, time.perf_counter() - began))

    def _run(self, s) -> DataFrame | None:
        if isinstance(s, ast.Select):
            return self.sql(s)
        if isinstance(s, ast.CreateDatabase):
            self.create_database(s.name)
        elif isinstance(s, ast.DropDatabase):
            self._drop_database(s)
        elif isinstance(s, ast.UseDatabase):
            if s.name not in self.databases:
                raise SemanticError(f"there is no database {s.name}")
            self.current = self.databases[s.name]
        elif isinstance(s, ast.CreateTable):
            self._create_table(s)
        elif isinstance(s, ast.DropTable):
            self._drop_tables(s)
        elif isinstance(s, ast.CreateIndex):
            self._create_index(s)
        elif isinstance(s, ast.DropIndex):
            for n in s.names:
                if n not in self.db.indexes:
                    if not s.if_exists:
                        raise SemanticError(f"there is no index {n}")
                    continue
                self._forget(self.db.indexes.pop(n))
        elif isinstance(s, ast.Insert):
            self._insert(s)
        elif isinstance(s, ast.Import):
            self.import_dsv(s)
        elif isinstance(s, ast.Instruction):
            if s.name not in self.instructions:
                raise SemanticError(f"there is no instruction \\{s.name}")
            self.instructions[s.name](self, s.args)
        else:
            raise NotSupported(f"{type(s).__name__.upper()} is parsed but not supported")
        return None

    def explain(self, text: str | ast.Select, mode: str = "formatted") -> str:
        """``graph``: the query graph, ``graph2sql``: the planned SQL, ``graphdot`` and ``plandot``: Graphviz; else one of Spark's explain modes."""
        p = self.plan(text)
        if mode == "graph":
            return str(p.graph)
        if mode == "graphdot":
            return p.graph.dot()
        if mode == "graph2sql":
            return p.sql
        df = self.spark.sql(p.sql)
        if mode == "plandot":
            return dumps.plan_dot(df)
        return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)

    # ---- definitions

    def _drop_database(self, s: ast.DropDatabase) -> None:
        if s.name not in self.databases:
            if not s.if_exists:
                raise SemanticError(f"there is no database {s.name}")
            return
        if self.current is not None and self.current.name == s.name:
            raise SemanticError(f"database {s.name} is in use")
        db = self.databases.pop(s.name)
        if any(x.managed for x in db.tables.values()):
            self.spark.sql(f"DROP DATABASE IF EXISTS {ident(self._space(db))} CASCADE")

    def _create_table(self, s: ast.CreateTable) -> None:
        if s.name in self.db.tables:
            raise SemanticError(f"table {s.name} exists already")
        names = [c.name for c in s.columns]
        if len(set(names)) < len(names):
            raise SemanticError(f"table {s.name} has two columns of the same name")
        if sum(c.primary for c in s.columns) > 1:
            raise SemanticError(f"table {s.name} has two primary keys")
        own = TableInfo({c.name: c.type for c in s.columns}, lambda _: "", lambda: 0.0)
        for c in s.columns:
            if c.references:
                other = self.table(c.references[0]).columns
                if c.references[1] not in other:
                    raise SemanticError(f"{c.references[0]} has no attribute {c.references[1]}")
                if not t.comparable(c.type, other[c.references[1]].type):
                    raise SemanticError(f"{c.name} can't refer to {'.'.join(c.references)} of another type")
            for check in c.check:
                b = Binder(lambda _: own, self.options)
                scope = _scope(s.name, own.columns)
                if b.bind(check, scope, "source").type != t.BOOL:
                    raise SemanticError(f"CHECK of {c.name} must be a boolean")
        relation = ident(self._space(self.db), s.name)
        cols = [f"{ident(c.name)} {c.type.sql}" for c in s.columns] + [f"{ident(h)} BIGINT" for h in (TS_BEGIN, TS_END) if self.multi_versioning]
        self.spark.sql(f"CREATE TABLE {relation} ({', '.join(cols)}) USING parquet")
        self.db.tables[s.name] = Table(s.name, {c.name: c for c in s.columns}, relation, True, self.multi_versioning)

    def _drop_tables(self, s: ast.DropTable) -> None:
        for n in s.names:
            if n not in self.db.tables and not s.if_exists:
                raise SemanticError(f"there is no table {n}")
        for n in s.names:
            x = self.db.tables.pop(n, None)
            if x is None:
                continue
            for k in [k for k, ix in self.db.indexes.items() if ix.table == n]:
                self._forget(self.db.indexes.pop(k))
            self.spark.sql(f"DROP TABLE {x.relation}" if x.managed else f"DROP VIEW {x.relation}")

    def _create_index(self, s: ast.CreateIndex) -> None:
        if s.name is None:
            raise SemanticError("an index needs a name")
        if s.unique:
            raise NotSupported("UNIQUE indexes are not supported")
        if s.name in self.db.indexes:
            if s.if_not_exists:
                return
            raise SemanticError(f"index {s.name} exists already")
        table = self.table(s.table)
        if s.method not in INDEX_METHODS:
            raise SemanticError(f"there is no index method {s.method}")
        if len(s.fields) != 1 or not isinstance(s.fields[0], ast.Name):
            raise NotSupported("an index has exactly one attribute")
        attr = s.fields[0].name
        if attr not in table.columns:
            raise SemanticError(f"{s.table} has no attribute {attr}")
        if s.method == "rmi" and not table.columns[attr].type.numeric:
            raise SemanticError("a learned index needs a numeric attribute")
        self.db.indexes[s.name] = Index(s.name, s.table, attr, s.method)

    def build_index(self, name: str, path: str) -> None:
        """Write a copy of the table sorted by the index's attribute to ``path``; point and range conditions on it then read only the row groups in range.

        Without a copy, such conditions are still pushed down to the table's files."""
        ix = self.db.indexes[name]
        table = self.table(ix.table)
        if table.versions:
            raise NotSupported("tables with row versions have no sorted copies")
        df = self.spark.sql(f"SELECT * FROM {table.relation}")
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        df.repartitionByRange(n, F.col(ident(ix.attribute))).sortWithinPartitions(F.col(ident(ix.attribute))).write.mode("overwrite").parquet(path)
        view = f"sparrowmill_{self._uid}_index_{name}"
        self.spark.read.schema(df.schema).parquet(path).createOrReplaceTempView(view)
        ix.view = view

    def _forget(self, ix: Index) -> None:
        if ix.view:
            self.spark.catalog.dropTempView(ix.view)
            ix.view = None

    # ---- data

    def _insert(self, s: ast.Insert) -> None:
        table = self.table(s.table)
        if not table.managed:
            raise SemanticError(f"{s.table} is a view")
        cols = list(table.columns.values())
        binder = Binder(lambda n: self._info(n, self._clock), self.options)
        rows = []
        for row in s.rows:
            if len(row) != len(cols):
                raise SemanticError(f"{s.table} has {len(cols)} columns, the row has {len(row)}")
            cells = []
            for c, e in zip(cols, row):
                if e in ("NULL", "DEFAULT") or (isinstance(e, ast.Const) and e.kind == "null"):
                    if c.not_null:
                        raise SemanticError(f"{c.name} can't be NULL")
                    cells.append(f"CAST(NULL AS {c.type.sql})")
                    continue
                b = binder.bind(e, _scope("", {}), "source")
                if not b.const:
                    raise SemanticError("only constants can be inserted")
                if not t.comparable(b.type, c.type):
                    raise SemanticError(f"{c.name} is of type {c.type}, not {b.type}")
                cells.append(f"substring({b.sql}, 1, {c.type.size})" if c.type.string and c.type.size else f"CAST({b.sql} AS {c.type.sql})")
            rows.append(f"({', '.join([*cells, *[str(self._clock), '-1'] * table.versions])})")
        self.spark.sql(f"INSERT INTO {table.relation} VALUES {', '.join(rows)}")
        self._changed(s.table)

    def append(self, name: str, rows: Iterable | DataFrame) -> None:
        """Append a DataFrame, or Python rows in column order."""
        table = self.table(name)
        with self._lock:
            self._clock += 1
            if not isinstance(rows, DataFrame):
                rows = self.spark.createDataFrame(list(rows), T.StructType([T.StructField(c.name, t.to_spark(c.type)) for c in table.columns.values()]))
            self._append(table, rows)

    def _append(self, table: Table, df: DataFrame) -> None:
        if not table.managed:
            raise SemanticError(f"{table.name} is a view")
        cols = [(F.substring(F.col(ident(d)), 1, c.type.size) if c.type.string and c.type.size else F.col(ident(d)).cast(c.type.sql)).alias(c.name) for d, c in zip(df.columns, table.columns.values())]
        if table.versions:
            cols += [F.lit(self._clock).cast("bigint").alias(TS_BEGIN), F.lit(-1).cast("bigint").alias(TS_END)]
        df.select(*cols).write.insertInto(table.relation)
        self._changed(table.name)

    def _changed(self, name: str) -> None:
        for ix in self.db.indexes.values():
            if ix.table == name:
                self._forget(ix)

    def import_dsv(self, s: ast.Import) -> None:
        table = self.table(s.table)
        self._append(table, dsv.read(self.spark, s.path, [(c.name, c.type) for c in table.columns.values()], s.rows, s.delimiter, s.escape, s.quote, s.has_header, s.skip_header))

    def load_csv(self, name: str, path: str, rows: int | None = None, has_header: bool = False, skip_header: bool = False) -> None:
        with self._lock:
            self._clock += 1
            self.import_dsv(ast.Import(name, path, rows, has_header=has_header or skip_header, skip_header=skip_header))

    # ---- statistics

    def learn_statistics(self) -> None:
        """Column statistics of all tables of the current database, in one pass each; join ordering uses them from now on."""
        for name, table in self.db.tables.items():
            self.db.statistics.learn(name, self.spark.sql(f"SELECT {', '.join(ident(c) for c in table.columns)} FROM {table.relation}"))
        self.options.estimator = self.db.statistics

    def close(self) -> None:
        """Drop what was made in Spark's catalog."""
        for db in self.databases.values():
            for x in db.tables.values():
                if not x.managed:
                    self.spark.sql(f"DROP VIEW IF EXISTS {x.relation}")
            for ix in db.indexes.values():
                self._forget(ix)
            if any(x.managed for x in db.tables.values()):
                self.spark.sql(f"DROP DATABASE IF EXISTS {ident(self._space(db))} CASCADE")
        self.databases, self.current = {}, None


def _scope(alias: str, columns: dict[str, Type]):
    from sparrowmill.sql.binder import Scope

    s = Scope(None)
    s.sources[alias] = columns
    return s


__all__ = ["Engine", "EngineError"]
