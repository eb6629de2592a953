"""Binder: resolves names, checks types and the scalar / vectorial category, and plans a SELECT as Spark SQL text.

Conditions are put in conjunctive normal form.  Clauses with one source become its filters, clauses with more become join
conditions; sources are joined in FROM order, or as a join-order enumerator finds it.  Catalyst takes it from there.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from sparrowmill import functions as fn
from sparrowmill import types as t
from sparrowmill.errors import SemanticError
from sparrowmill.plans import cnf, joinorder
from sparrowmill.plans.cardinality import CartesianProduct, Equality, Relation, Statistics
from sparrowmill.sql import ast
from sparrowmill.types import Type


def ident(*parts: str) -> str:
    return ".".join("`" + p.replace("`", "``") + "`" for p in parts)


@dataclass(frozen=True)
class Bound:
    """An expression as Spark SQL.  ``vector``: a column rather than one value; ``const``: made of literals only."""

    sql: str
    type: Type
    vector: bool = False
    const: bool = True
    refs: frozenset = frozenset()
    outer: bool = False


def combine(sql: str, ty: Type, *parts: Bound) -> Bound:
    return Bound(sql, ty, any(p.vector for p in parts), all(p.const for p in parts), frozenset().union(*(p.refs for p in parts)), any(p.outer for p in parts))


@dataclass
class TableInfo:
    """What the binder needs of a table: visible columns, and the SQL of a relation, given the conditions on single columns."""

    columns: dict[str, Type]
    relation: Callable[[list[tuple[str, str, object]]], str]
    rows: Callable[[], float]
    size: Callable[[], float] = lambda: math.inf  # bytes
    first: Callable[[str], tuple | None] = lambda _: None  # the first row of a Spark SQL query over it; None for streams


@dataclass
class Options:
    enumerator: str | None = None
    estimator: CartesianProduct = field(default_factory=Statistics)
    join_hint: str | None = None  # Spark's name of a join hint
    compat_decimal: bool = False
    search: dict | None = None  # options of the enumerator HeuristicSearch
    join_cost: Callable[[float, float, float], float] | None = None  # of the sizes of both inputs and the result
    broadcast_bytes: int = 64 << 20  # a larger table isn't broadcast, whatever the hint
    fan_out: int = 64  # a join with so many partners a row is made block by block
    slices: int = 200  # of such a join, at least, if it has enough pairs


#: Of joins block by block: rows in a block, rows of a table that is broadcast in blocks, pairs in a task (at least and about), tasks.
BLOCK_ROWS, BLOCKED_ROWS, LEAST_PAIRS, TASK_PAIRS, MOST_TASKS = 256, 2_000_000, 1_000_000, 16_000_000, 10_000
BUCKETS, BLOCKS = 4096, "#blocks"


@dataclass
class QueryGraph:
    """Sources, filters of each, joins, and what follows; kept for inspection."""

    sources: list[Relation] = field(default_factory=list)
    filters: dict[str, list[str]] = field(default_factory=dict)
    joins: list[tuple[tuple[str, ...], str]] = field(default_factory=list)
    group_by: list[str] = field(default_factory=list)
    aggregates: list[str] = field(default_factory=list)
    projections: list[str] = field(default_factory=list)
    order_by: list[str] = field(default_factory=list)
    limit: tuple[int, int] | None = None
    tree: object = None
    cost: float | None = None
    blocks: str | None = None  # alias of the source that is joined in blocks

    def dot(self) -> str:
        """The graph in Graphviz's language."""
        lines = ["graph query {"]
        for s in self.sources:
            lines.append(f'  "{s.alias}" [label="{s.alias}\\n{" AND ".join(self.filters.get(s.alias, []))}"];'.replace("`", ""))
        for refs, sql in self.joins:
            if len(refs) == 2:
                lines.append(f'  "{refs[0]}" -- "{refs[1]}" [label="{sql}"];'.replace("`", ""))
        return "\n".join([*lines, "}"])


@dataclass
class Plan:
    sql: str
    fields: list[tuple[str, Type]]
    graph: QueryGraph
    #: Names that several result columns have; they can't be referred to.
    twice: frozenset = frozenset()


class Scope:
    def __init__(self, parent: Scope | None, barrier: bool = False) -> None:
        self.parent, self.barrier = parent, barrier
        self.sources: dict[str, dict[str, Type]] = {}
        self.twice: dict[str, frozenset] = {}
        self.used: dict[str, dict[str, None]] = {}  # columns that were referred to, in order
        self.group: Grouping | None = None

    def aliases(self) -> set[str]:
        return set(self.sources) | (self.parent.aliases() if self.parent and not self.barrier else set())


@dataclass
class Grouping:
    name: str
    keys: list[tuple[ast.Expr, str | None, Bound]] = field(default_factory=list)  # resolved expression, alias, bound
    aggregates: dict[ast.Expr, tuple[str, str, Type]] = field(default_factory=dict)  # call -> column, SQL, type

    def key(self, i: int) -> Bound:
        b = self.keys[i][2]
        return Bound(ident(self.name, f"#k{i}"), b.type, False, False)


class Binder:
    def __init__(self, lookup: Callable[[str], TableInfo], options: Options) -> None:
        self.lookup, self.options, self.counter = lookup, options, 0

    # ---- names

    def resolve(self, n: ast.Name, scope: Scope) -> tuple[Scope, str, Type]:
        """The scope and alias that a name means, from the innermost scope outwards."""
        at: Scope | None = scope
        while at is not None:
            if n.prefix is not None:
                if n.prefix in at.sources:
                    if n.name not in at.sources[n.prefix]:
                        raise SemanticError(f"{n.prefix} has no attribute {n.name}", n.pos)
                    return self._reach(n, scope, at), n.prefix, self._once(n, at, n.prefix)
            else:
                found = [a for a, cols in at.sources.items() if n.name in cols]
                if len(found) > 1:
                    raise SemanticError(f"{n.name} is ambiguous: it is in {' and '.join(found)}", n.pos)
                if found:
                    return self._reach(n, scope, at), found[0], self._once(n, at, found[0])
            at = at.parent
        raise SemanticError(f"{n} is not found", n.pos)

    def _once(self, n: ast.Name, at: Scope, alias: str) -> Type:
        at.used.setdefault(alias, {})[n.name] = None
        if n.name in at.twice.get(alias, ()):
            raise SemanticError(f"{n.name} is ambiguous: {alias} has several columns of this name", n.pos)
        return at.sources[alias][n.name]

    def _reach(self, n: ast.Name, scope: Scope, at: Scope) -> Scope:
        s = scope
        while s is not at:
            if s.barrier:
                raise SemanticError(f"{n} of an outer query can't be used in a subquery of FROM", n.pos)
            s = s.parent
        return at

    def full(self, e: ast.Expr, scope: Scope) -> ast.Expr:
        """The expression with all names prefixed, for comparing."""
        if isinstance(e, ast.Name):
            _, alias, _ = self.resolve(e, scope)
            return ast.Name(alias, e.name)
        if isinstance(e, ast.Unary):
            return ast.Unary(e.op, self.full(e.arg, scope))
        if isinstance(e, ast.Binary):
            return ast.Binary(e.op, self.full(e.left, scope), self.full(e.right, scope))
        if isinstance(e, ast.Call):
            return ast.Call(e.fn, tuple(self.full(a, scope) for a in e.args), e.star)
        return e

    def _full_or_none(self, e: ast.Expr, scope: Scope) -> ast.Expr | None:
        try:
            return self.full(e, scope)
        except SemanticError:
            return None

    # ---- expressions

    def bind(self, e: ast.Expr, scope: Scope, where: str) -> Bound:
        """``where``: "source" (names mean sources, no aggregates), "grouped" (names mean keys) or "plain" (sources; aggregates are an error told elsewhere)."""
        try:
            return self._bind(e, scope, where)
        except SemanticError as x:
            if x.pos is None and getattr(e, "pos", (0, 0)) != (0, 0):
                raise SemanticError(str(x), e.pos) from None
            raise

    def _bind(self, e: ast.Expr, scope: Scope, where: str) -> Bound:
        if where == "grouped":
            g = scope.group
            if isinstance(e, ast.Name) and e.prefix is None:
                named = [i for i, k in enumerate(g.keys) if k[1] == e.name]
                if len(named) > 1:
                    raise SemanticError(f"{e.name} names several grouping keys", e.pos)
                if named:
                    return g.key(named[0])
            if not isinstance(e, (ast.Const, ast.Subquery)) and (f := self._full_or_none(e, scope)) is not None:
                for i, k in enumerate(g.keys):
                    if k[0] == f:
                        return g.key(i)
        if isinstance(e, ast.Const):
            return Bound(*fn.literal(e.kind, e.value))
        if isinstance(e, ast.Name):
            at, alias, ty = self.resolve(e, scope)
            if at is not scope:
                if at.group is not None:
                    for i, k in enumerate(at.group.keys):
                        if k[0] == ast.Name(alias, e.name):
                            return Bound(at.group.key(i).sql, ty, False, False, frozenset(), True)
                    raise SemanticError(f"{e} is not a grouping key of the outer query", e.pos)
                return Bound(ident(alias, e.name), ty, False, False, frozenset(), True)
            if where == "grouped":
                raise SemanticError(f"{e} is neither a grouping key nor in an aggregate", e.pos)
            return Bound(ident(alias, e.name), ty, True, False, frozenset([alias]))
        if isinstance(e, ast.Unary):
            a = self.bind(e.arg, scope, where)
            return combine(*fn.unary(e.op, a.sql, a.type), a)
        if isinstance(e, ast.Binary):
            a, b = self.bind(e.left, scope, where), self.bind(e.right, scope, where)
            return combine(*fn.binary(e.op, a.sql, a.type, b.sql, b.type, self.options.compat_decimal), a, b)
        if isinstance(e, ast.Call):
            return self._call(e, scope, where)
        if isinstance(e, ast.Subquery):
            return self._scalar(e, scope)
        raise SemanticError(f"{e} can't be evaluated")

    def _call(self, e: ast.Call, scope: Scope, where: str) -> Bound:
        if e.fn in fn.SCALARS:
            if e.star:
                raise SemanticError(f"{e.fn}(*) is not a function", e.pos)
            args = [self.bind(a, scope, where) for a in e.args]
            return combine(*fn.scalar(e.fn, [(a.sql, a.type) for a in args]), *args)
        if e.fn not in fn.AGGREGATES:
            raise SemanticError(f"there is no function {e.fn}", e.pos)
        if where != "grouped":
            raise SemanticError(f"the aggregate {e} is not allowed here", e.pos)
        if e.star and e.fn != "COUNT" or not e.star and len(e.args) != 1 and (e.fn != "COUNT" or e.args):
            raise SemanticError(f"{e.fn} takes one argument", e.pos)
        arg = self.bind(e.args[0], scope, "source") if e.args else None
        sql, ty = fn.aggregate(e.fn, arg.sql if arg else None, arg.type if arg else None)
        key = ast.Call(e.fn, tuple(self.full(a, scope) for a in e.args), e.star or not e.args)
        g = scope.group
        name, _, ty = g.aggregates.setdefault(key, (f"#a{len(g.aggregates)}", sql, ty))
        return Bound(ident(g.name, name), ty, False, False)

    def _scalar(self, e: ast.Subquery, scope: Scope) -> Bound:
        s = e.select
        p = self.select(s, scope)
        if len(p.fields) != 1:
            raise SemanticError("a scalar subquery has one column", e.pos)
        grouped = s.having is not None or any(has_aggregate(x) for x, _ in s.items)
        if not (not s.sources or (grouped and s.group is None)):
            raise SemanticError("a scalar subquery must yield exactly one value", e.pos)
        return Bound(f"({p.sql})", p.fields[0][1], False, not s.sources)

    # ---- select

    def select(self, s: ast.Select, parent: Scope | None = None, barrier: bool = False) -> Plan:
        scope, g = Scope(parent, barrier), QueryGraph()
        relations: list[tuple[str, Callable]] = []
        infos: dict[str, TableInfo] = {}
        for src in s.sources:
            if src.alias in scope.aliases():
                raise SemanticError(f"the alias {src.alias} is already in use", src.pos)
            if isinstance(src.what, str):
                info = infos[src.alias] = self.lookup(src.what)
                scope.sources[src.alias] = info.columns
                relations.append((src.alias, lambda flt, r=info.relation, a=src.alias: f"{r(flt)} AS {ident(a)}"))
                sized = self.options.enumerator or self.options.join_hint
                g.sources.append(Relation(src.alias, src.what, info.rows() if sized else 0.0, size=info.size() if sized else math.inf))
            else:
                sub = self.select(src.what, scope if parent is None else Scope(parent), True)
                scope.sources[src.alias] = dict(sub.fields)
                scope.twice[src.alias] = sub.twice
                relations.append((src.alias, lambda flt, q=sub.sql, a=src.alias: f"({q}) AS {ident(a)}"))
                g.sources.append(Relation(src.alias, None, 1e6))
        clauses = self._where(s, scope, g)
        grouped = s.group is not None or s.having is not None or any(has_aggregate(e) for e, _ in s.items) or any(has_aggregate(e) for e, _ in s.order)
        if grouped:
            return self._grouped(s, scope, g, self._from(relations, clauses, g) if s.sources else "")
        items = self._items(s, scope, "plain")
        vector = [b for _, b in items if b.vector]
        if s.sources and vector and any(not b.vector and not b.const and "(SELECT" not in b.sql and not b.outer for _, b in items):
            raise SemanticError("columns and single values can't be mixed", s.pos)
        order = self._order(s, scope, "plain", items)
        results = [*(b.sql for _, b in items), *(b.sql for b, _ in order)]
        blocked = len(infos) == len(s.sources) == 2 and not self.options.join_hint and not (s.limit and not order) and not any("(SELECT" in x for x in [*results, *(b.sql for b, _ in clauses)])
        frm = blocked and self._in_blocks(relations, clauses, results, scope, g, infos) or (self._from(relations, clauses, g) if s.sources else "")
        return self._emit(s, g, items, order, frm)

    def _where(self, s: ast.Select, scope: Scope, g: QueryGraph) -> list[tuple[Bound, list]]:
        out = []
        if s.where is None:
            return out
        whole = self.bind(s.where, scope, "source")
        if whole.type not in (t.BOOL, t.NULL):
            raise SemanticError(f"WHERE needs a boolean, not {whole.type}", s.where.pos)
        for clause in cnf.clauses(s.where):
            parts = [self.bind(x, scope, "source") for x in clause]
            b = combine(parts[0].sql if len(parts) == 1 else "(" + " OR ".join(p.sql for p in parts) + ")", t.BOOL, *parts)
            out.append((b, clause))
            refs = tuple(sorted(b.refs))
            if len(refs) == 1:
                g.filters.setdefault(refs[0], []).append(b.sql)
                if len(clause) == 1 and (simple := _simple(clause[0])):
                    next(r for r in g.sources if r.alias == refs[0]).filters.append(simple)
            elif refs:
                g.joins.append((refs, b.sql))
        return out

    def _from(self, relations, clauses, g: QueryGraph) -> str:
        """FROM and WHERE; join conditions stand at the join that completes their sources."""
        names = [a for a, _ in relations]
        at = {a: i for i, a in enumerate(names)}
        tree: object = 0
        for i in range(1, len(names)):
            tree = (tree, i)
        if self.options.enumerator and len(names) > 1:
            joins = [b for b, _ in clauses if len(b.refs) > 1 and not b.outer]
            edges = {tuple(sorted((at[x], at[y]))) for b in joins for x in b.refs for y in b.refs if x < y}
            eqs = [e for b, c in clauses if len(c) == 1 and (e := _equality(c[0], at, g, self))]
            est = self.options.estimator
            cache: dict[int, float] = {}

            def sizes(mask: int) -> float:
                if mask not in cache:
                    members = list(joinorder.bits(mask))
                    cache[mask] = est.scan(g.sources[members[0]]) if len(members) == 1 else est.join(g.sources, members, eqs)
                return cache[mask]

            g.cost, tree = joinorder.order(joinorder.Graph(len(names), edges, sizes, *filter(None, [self.options.join_cost])), self.options.enumerator, self.options.search)
        g.tree = tree
        pending = [b for b, _ in clauses if len(b.refs) > 1 and not b.outer]
        rest = [b for b, _ in clauses if len(b.refs) <= 1 or b.outer]
        filters = {r.alias: r.filters for r in g.sources}

        def emit(node) -> tuple[str, set]:
            if isinstance(node, int):
                a, rel = relations[node]
                return rel(filters[a]), {a}
            (ls, lr), (rs, rr) = emit(node[0]), emit(node[1])
            refs = lr | rr
            on = [b for b in pending if b.refs <= refs]
            for b in on:
                pending.remove(b)
            if isinstance(node[1], tuple):
                rs = f"({rs})"
            return (f"{ls} INNER JOIN {rs} ON {' AND '.join(b.sql for b in on)}" if on else f"{ls} CROSS JOIN {rs}"), refs

        sql, _ = emit(tree)
        where = f" WHERE {' AND '.join(b.sql for b in rest)}" if rest else ""
        return f" FROM {sql}{where}"

    def _in_blocks(self, relations, clauses, results: list[str], scope: Scope, g: QueryGraph, infos: dict[str, TableInfo]) -> str | None:
        """FROM and WHERE of a join with many partners a row, or None if it isn't one.

        The result is far larger than both inputs, so their sizes say nothing about the work: the larger source is dealt evenly over
        slices by the number of pairs, and the smaller is broadcast with the rows of a key in blocks, which are unrolled row by row."""
        sizes = {a: info.size() for a, info in infos.items()}
        small = min(reversed(sizes), key=sizes.get)
        large = next(a for a in sizes if a != small)
        at = {a: i for i, a in enumerate(infos)}
        keys = [(b, e) for b, c in clauses if len(b.refs) == 2 and not b.outer and len(c) == 1 and (e := _equality(c[0], at, g, self))]
        if not keys or any(b.outer for b, _ in clauses) or not sizes[small] <= self.options.broadcast_bytes:
            return None
        filters = {r.alias: r.filters for r in g.sources}

        def side(alias: str) -> tuple[list[str], str]:
            cols = [ident(alias, next(c for i, c in (e.left, e.right) if i == at[alias])) for _, e in keys]
            own = [b.sql for b, _ in clauses if b.refs == {alias}]
            return cols, f" FROM {dict(relations)[alias](filters[alias])} WHERE {' AND '.join([*(f'{c} IS NOT NULL' for c in cols), *own])}"

        def counted(alias: str) -> str:
            cols, frm = side(alias)
            return f"(SELECT {', '.join(f'{c} AS {ident(f"#k{i}")}' for i, c in enumerate(cols))}, COUNT(*) AS `#n`{frm} GROUP BY {', '.join(cols)})"

        # rows of hashed keys less those that meet by chance tell most joins apart from these, without a group for each key
        cols, frm = side(small)
        some = infos[small].first(f"SELECT SUM(CAST(n AS DOUBLE) * n), SUM(n) FROM (SELECT COUNT(*) AS n{frm} GROUP BY pmod(xxhash64({', '.join(cols)}), {BUCKETS}))")
        if some is None or not some[1] or (some[0] - some[1] ** 2 / BUCKETS) / some[1] < 0.9 * self.options.fan_out:
            return None
        one = infos[small].first(f"SELECT SUM(CAST(`#n` AS DOUBLE) * `#n`) / SUM(`#n`), SUM(`#n`) FROM {counted(small)}")
        if one is None or one[0] is None or one[0] < self.options.fan_out or one[1] > BLOCKED_ROWS:
            return None
        same = " AND ".join(f"`#l`.{ident(f'#k{i}')} = `#s`.{ident(f'#k{i}')}" for i in range(len(keys)))
        both = infos[large].first(f"SELECT COALESCE(SUM(CAST(`#l`.`#n` AS DOUBLE) * `#s`.`#n`), 0) FROM {counted(large)} AS `#l` JOIN {counted(small)} AS `#s` ON {same}")
        if both is None:
            return None
        slices = min(MOST_TASKS, max(1, min(self.options.slices, math.ceil(both[0] / LEAST_PAIRS)), math.ceil(both[0] / TASK_PAIRS)))
        rest = [b.sql for b, _ in clauses if b not in [k for k, _ in keys] and len(b.refs) != 1]
        used = [c for c in scope.used[small] if any(ident(small, c) in x for x in [*results, *rest])] or list(scope.used[small])
        row = ", ".join(ident(small, c) for c in used)
        named = ", ".join(f"{c} AS {ident(f'#k{i}')}" for i, c in enumerate(cols))
        blocks = f"(SELECT {named}, collect_list(struct({row})) AS `#rows`{frm} GROUP BY {', '.join(cols)}, pmod(xxhash64({row}), {math.ceil(one[0] / BLOCK_ROWS)})) AS {ident(BLOCKS)}"
        on = " AND ".join(b.sql.replace(c, ident(BLOCKS, f"#k{i}")) for i, (c, (b, _)) in enumerate(zip(cols, keys)))
        where = f" WHERE {' AND '.join(rest)}" if rest else ""
        g.tree, g.blocks = (at[large], at[small]), small
        dealt = f"(SELECT /*+ REPARTITION({slices}) */ {', '.join(ident(large, c) for c in scope.used[large])}{side(large)[1]}) AS {ident(large)}"
        return f" FROM {dealt} INNER JOIN {blocks} ON {on} LATERAL VIEW inline({ident(BLOCKS, '#rows')}) {ident(small)} AS {', '.join(ident(c) for c in used)}{where}"

    def _hint(self, g: QueryGraph) -> str:
        """The hint names the smallest source, by the optimizer's estimate; one above the limit isn't broadcast."""
        if g.blocks:
            return f"/*+ BROADCAST({ident(BLOCKS)}) */ "
        hint = self.options.join_hint
        if not hint or len(g.sources) < 2:
            return ""
        small = min(reversed(g.sources), key=lambda r: r.size)
        if hint == "BROADCAST" and not small.size <= self.options.broadcast_bytes:
            return ""
        return f"/*+ {hint}({ident(small.alias)}) */ "

    def _items(self, s: ast.Select, scope: Scope, where: str) -> list[tuple[str, Bound]]:
        raw: list[tuple[str, Bound]] = []
        if s.star:
            if where == "grouped":
                raw += [(k[1] or (k[0].name if isinstance(k[0], ast.Name) else str(k[0])), scope.group.key(i)) for i, k in enumerate(scope.group.keys)]
                if not raw:
                    raise SemanticError("SELECT * needs grouping keys here", s.pos)
                if len({n for n, _ in raw}) < len(raw):
                    raise SemanticError("SELECT * is ambiguous: grouping keys have the same name", s.pos)
            elif not scope.sources:
                raise SemanticError("SELECT * needs FROM", s.pos)
            elif any(scope.twice.values()):
                raise SemanticError("SELECT * is ambiguous: a subquery has columns of the same name", s.pos)
            else:
                raw += [(c, Bound(ident(a, c), ty, True, False, frozenset([a]))) for a, cols in scope.sources.items() for c, ty in cols.items()]
                scope.used = {a: dict.fromkeys(cols) for a, cols in scope.sources.items()}
        consts = 0
        for e, alias in s.items:
            b = self.bind(e, scope, where)
            if alias is None:
                if b.const and not isinstance(e, ast.Name):
                    alias, consts = f"$const{consts}", consts + 1
                else:
                    alias = e.name if isinstance(e, ast.Name) else str(e)
            raw.append((alias, b))
        seen: dict[str, int] = {}
        out = []
        for name, b in raw:  # later columns of a name get a suffix
            n = seen.get(name, 0)
            seen[name] = n + 1
            out.append((f"{name}${n}" if n else name, b))
        return out

    def _order(self, s: ast.Select, scope: Scope, where: str, items) -> list[tuple[Bound, bool]]:
        out = []
        results = {}
        for name, b in items:
            results.setdefault(name, b)
        for e, asc in s.order:
            if isinstance(e, ast.Name) and e.prefix is None and e.name in results:
                if f"{e.name}$1" in results and results[f"{e.name}$1"].sql != results[e.name].sql:
                    raise SemanticError(f"{e.name} is ambiguous: several results have this name", e.pos)
                b = results[e.name]
            else:
                b = self.bind(self._replace(e, s, items), scope, where)
            if where == "plain" and not b.vector and s.sources or b.const:
                raise SemanticError("ORDER BY needs columns, not single values", getattr(e, "pos", None))
            out.append((b, asc))
        return out

    def _replace(self, e: ast.Expr, s: ast.Select, items) -> ast.Expr:
        """Names of aliased results within a larger sort expression stand for their expressions."""
        named = {alias: x for x, alias in s.items if alias is not None}

        def walk(x: ast.Expr) -> ast.Expr:
            if isinstance(x, ast.Name) and x.prefix is None and x.name in named:
                return named[x.name]
            if isinstance(x, ast.Unary):
                return ast.Unary(x.op, walk(x.arg), x.pos)
            if isinstance(x, ast.Binary):
                return ast.Binary(x.op, walk(x.left), walk(x.right), x.pos)
            if isinstance(x, ast.Call) and x.fn in fn.SCALARS:
                return ast.Call(x.fn, tuple(walk(a) for a in x.args), x.star, x.pos)
            return x

        return e if isinstance(e, ast.Name) else walk(e)

    def _emit(self, s: ast.Select, g: QueryGraph, items, order, frm: str, where: str = "") -> Plan:
        cols = ", ".join(f"{b.sql} AS {ident(n)}" for n, b in items)
        g.projections = [f"{b.sql} AS {n}" for n, b in items]
        sql = f"SELECT {self._hint(g) if not where else ''}{cols}{frm}"
        if order:
            g.order_by = [f"{b.sql} {'ASC' if asc else 'DESC'}" for b, asc in order]
            sql += " ORDER BY " + ", ".join(f"{x} NULLS FIRST" for x in g.order_by)
        if s.limit:
            g.limit = s.limit
            sql += f" LIMIT {s.limit[0]}" + (f" OFFSET {s.limit[1]}" if s.limit[1] else "")
        names = {n for n, _ in items}
        return Plan(sql, [(n, b.type) for n, b in items], g, frozenset(n for n in names if f"{n}$1" in names))

    def _grouped(self, s: ast.Select, scope: Scope, g: QueryGraph, frm: str) -> Plan:
        if not s.sources:
            raise SemanticError("grouping needs FROM", s.pos)
        self.counter += 1
        keys = []
        for e, alias in s.group or ():
            b = self.bind(e, scope, "source")
            if not b.vector:
                raise SemanticError("a grouping key must be a column", e.pos)
            keys.append((self.full(e, scope), alias or (e.name if isinstance(e, ast.Name) else None), b))
        scope.group = Grouping(f"#g{self.counter}", keys)
        having = None
        if s.having is not None:
            having = self.bind(s.having, scope, "grouped")
            if having.type not in (t.BOOL, t.NULL) or having.vector:
                raise SemanticError("HAVING needs one boolean a group", s.having.pos)
        items = self._items(s, scope, "grouped")
        order = self._order(s, scope, "grouped", items)
        cols = [f"{b.sql} AS {ident(f'#k{i}')}" for i, (_, _, b) in enumerate(keys)]
        cols += [f"{sql} AS {ident(name)}" for name, sql, _ in scope.group.aggregates.values()]
        if not cols:
            cols = ["COUNT(*) AS `#n`"]
        g.group_by = [b.sql for _, _, b in keys]
        g.aggregates = [sql for _, sql, _ in scope.group.aggregates.values()]
        inner = f"SELECT {self._hint(g)}{', '.join(cols)}{frm}" + (f" GROUP BY {', '.join(g.group_by)}" if keys else "")
        outer = f" FROM ({inner}) AS {ident(scope.group.name)}" + (f" WHERE {having.sql}" if having else "")
        return self._emit(s, g, items, order, outer, "grouped")


def has_aggregate(e: ast.Expr) -> bool:
    if isinstance(e, ast.Call):
        return e.fn in fn.AGGREGATES or any(has_aggregate(a) for a in e.args)
    if isinstance(e, ast.Unary):
        return has_aggregate(e.arg)
    return isinstance(e, ast.Binary) and (has_aggregate(e.left) or has_aggregate(e.right))


_FLIP = {"<": ">", ">": "<", "<=": ">=", ">=": "<=", "=": "=", "!=": "!="}


def _simple(e: ast.Expr) -> tuple[str, str, object] | None:
    """(attribute, operator, constant) of a comparison of a column with a literal."""
    if isinstance(e, ast.Binary) and e.op in _FLIP:
        if isinstance(e.left, ast.Name) and isinstance(e.right, ast.Const):
            return e.left.name, e.op, e.right.value
        if isinstance(e.right, ast.Name) and isinstance(e.left, ast.Const):
            return e.right.name, _FLIP[e.op], e.left.value
    return None


def _equality(e: ast.Expr, at: dict[str, int], g: QueryGraph, binder: Binder) -> Equality | None:
    if not (isinstance(e, ast.Binary) and e.op == "=" and isinstance(e.left, ast.Name) and isinstance(e.right, ast.Name)):
        return None
    sides = []
    for n in (e.left, e.right):
        if n.prefix in at:
            sides.append((at[n.prefix], n.name))
        else:
            own = [r.alias for r in g.sources if r.table and n.name in binder.lookup(r.table).columns]
            if len(own) != 1:
                return None
            sides.append((at[own[0]], n.name))
    return Equality(*sides)


__all__ = ["Binder", "Bound", "Options", "Plan", "QueryGraph", "TableInfo", "ident"]
