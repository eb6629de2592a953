"""Cardinality estimators for join ordering."""

from __future__ import annotations

import json
import math
import warnings
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Relation:
    """A source of a query: alias, table (None for a subquery), rows, and its filters as (attribute, operator, constant)."""

    alias: str
    table: str | None
    rows: float
    filters: list[tuple[str, str, object]] = field(default_factory=list)
    size: float = math.inf  # bytes


@dataclass
class Equality:
    """A join predicate attribute = attribute."""

    left: tuple[int, str]
    right: tuple[int, str]


class CartesianProduct:
    """Filters and groupings leave sizes unchanged; joins multiply."""

    def scan(self, r: Relation) -> float:
        return max(1.0, r.rows)

    def join(self, relations: Sequence[Relation], members: list[int], equalities: Sequence[Equality]) -> float:
        return math.prod(self.scan(relations[i]) for i in members)

    def grouping(self, rows: float, distinct: Sequence[float]) -> float:
        return rows

    def limit(self, rows: float, n: int, offset: int = 0) -> float:
        return min(max(0.0, rows - offset), n)


class Injected(CartesianProduct):
    """Sizes given for sets of relations: ``{database: [{"relations": [...], "size": n}, ...]}``; others fall back to products, with a warning."""

    def __init__(self, given: dict | str, database: str) -> None:
        if isinstance(given, str):
            with open(given) as f:
                given = json.load(f)
        self.sizes = {frozenset(x["relations"]): float(x["size"]) for x in given.get(database, [])}

    def scan(self, r: Relation) -> float:
        return self.sizes.get(frozenset([r.alias]), super().scan(r))

    def join(self, relations, members, equalities) -> float:
        key = frozenset(relations[i].alias for i in members)
        if key in self.sizes:
            return self.sizes[key]
        warnings.warn(f"no size given for {sorted(key)}", stacklevel=2)
        return super().join(relations, members, equalities)

    def grouping(self, rows, distinct) -> float:
        return rows


class Statistics(CartesianProduct):
    """Estimates from learned column statistics: rows, distinct values and quantiles.  Of a table that none are known of, a join attribute
    counts as a key: a join with it keeps the other side's rows."""

    def __init__(self) -> None:
        self.tables: dict[str, dict] = {}

    def learn(self, table: str, df: DataFrame, quantiles: int = 20) -> None:
        """One pass of built-in sketches over the table; memory doesn't depend on its rows."""
        cols = df.columns
        numeric = {c for c, k in df.dtypes if k in ("tinyint", "smallint", "int", "bigint", "float", "double") or k.startswith("decimal")}
        aggs = [F.count(F.lit(1)).alias("rows")]
        for i, c in enumerate(cols):
            aggs += [F.approx_count_distinct(c).alias(f"d{i}"), F.count(c).alias(f"n{i}")]
            if c in numeric:
                aggs.append(F.percentile_approx(F.col(c).cast("double"), [k / quantiles for k in range(quantiles + 1)]).alias(f"q{i}"))
        got = df.agg(*aggs).first()
        self.tables[table] = {"rows": got["rows"], "columns": {c: {"distinct": max(1, got[f"d{i}"]), "present": got[f"n{i}"] / max(1, got["rows"]), "quantiles": got[f"q{i}"] if c in numeric else None} for i, c in enumerate(cols)}}

    def selectivity(self, table: str, attr: str, op: str, value) -> float:
        c = self.tables[table]["columns"].get(attr)
        if c is None:
            return 1.0
        if op == "=":
            return c["present"] / c["distinct"]
        if op == "!=":
            return c["present"] * (1 - 1 / c["distinct"])
        q = c["quantiles"]
        if q is None or not isinstance(value, (int, float)):
            return 1 / 3
        below = sum((min(max((value - a) / (b - a), 0.0), 1.0) if b > a else float(value >= b)) for a, b in zip(q, q[1:])) / (len(q) - 1)
        return c["present"] * (below if op in ("<", "<=") else 1 - below)

    def scan(self, r: Relation) -> float:
        if r.table not in self.tables:
            return super().scan(r)
        rows = self.tables[r.table]["rows"]
        for attr, op, value in r.filters:
            rows *= self.selectivity(r.table, attr, op, value)
        return max(1.0, rows)

    def _distinct(self, r: Relation, attr: str) -> float:
        if r.table in self.tables and attr in self.tables[r.table]["columns"]:
            return float(self.tables[r.table]["columns"][attr]["distinct"])
        return max(1.0, r.rows)

    def join(self, relations, members, equalities) -> float:
        rows = math.prod(self.scan(relations[i]) for i in members)
        inside = set(members)
        for e in equalities:
            if e.left[0] in inside and e.right[0] in inside:
                rows /= max(self._distinct(relations[e.left[0]], e.left[1]), self._distinct(relations[e.right[0]], e.right[1]))
        return max(1.0, rows)

    def grouping(self, rows, distinct) -> float:
        return min(rows, math.prod(distinct)) if distinct else 1.0
