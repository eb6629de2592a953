"""Functions and operators of the dialect, each as typed Spark SQL text."""

from __future__ import annotations

from sparrowmill import types as t
from sparrowmill.errors import SemanticError
from sparrowmill.types import Type

#: The dialect's functions.
AGGREGATES = ("COUNT", "SUM", "AVG", "MIN", "MAX")
SCALARS = ("ISNULL", "INT")


def literal(kind: str, value) -> tuple[str, Type]:
    if kind == "int":
        if value < 1 << 31:
            return str(value), t.INT4
        if value >= 1 << 63:
            raise SemanticError(f"{value} is too large for INT(8)")
        return f"{value}L", t.INT8
    if kind == "float":
        return f"{value!r}D" if value == value and abs(value) != float("inf") else f"double('{value}')", t.DOUBLE
    if kind == "string":
        return quote(value), Type("char", max(1, len(value.encode())))
    if kind == "bool":
        return str(value).upper(), t.BOOL
    if kind == "null":
        return "NULL", t.NULL
    check_date(value)
    return (f"DATE'{value}'", t.DATE) if kind == "date" else (f"TIMESTAMP_NTZ'{value}'", t.DATETIME)


def quote(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\t", "\\t") + "'"


def check_date(text: str) -> None:
    """Months by their length, no year 0, hours below 24.  29 February must exist in its year, since Spark can't hold it otherwise."""
    day, _, time = text.partition(" ")
    neg = day.startswith("-")
    y, m, d = (int(x) for x in day.lstrip("-").split("-"))
    if y == 0:
        raise SemanticError(f"there is no year 0 in d'{text}'")
    year = 1 - y if neg else y
    leap = year % 4 == 0 and (year % 100 != 0 or year % 400 == 0)
    if not 1 <= m <= 12 or not 1 <= d <= (31, 29 if leap else 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)[m - 1]:
        raise SemanticError(f"d'{text}' is not a date")
    if time and not (time[:2] < "24" and time[3:5] < "60" and time[6:] < "60"):
        raise SemanticError(f"d'{text}' has no such time")


def cast(sql: str, have: Type, want: Type) -> str:
    return sql if have == want else f"CAST({sql} AS {want.sql})"


def arithmetic(op: str, a: str, ta: Type, b: str, tb: Type, compat_decimal: bool = False) -> tuple[str, Type]:
    """Integers divide by truncation; results have the joined type; decimals keep Spark's digits unless ``compat_decimal``."""
    if t.NULL in (ta, tb):
        other = tb if ta == t.NULL else ta
        if other != t.NULL and not other.numeric:
            raise SemanticError(f"{op} needs numbers, not {other}")
        return f"CAST(NULL AS {(t.INT4 if other == t.NULL else other).sql})", t.INT4 if other == t.NULL else other
    if not (ta.numeric and tb.numeric):
        raise SemanticError(f"{op} needs numbers, not {ta} and {tb}")
    j = t.arithmetic_join(ta, tb)
    if j.kind == "decimal":
        dec = lambda s, ty: s if ty.kind in ("decimal", "int") else f"CAST({s} AS DECIMAL(19,{j.scale}))"
        sql = f"({dec(a, ta)} {op} {dec(b, tb)})"
        return (f"CAST({sql} AS {j.sql})" if compat_decimal else sql), j
    a, b = cast(a, ta, j), cast(b, tb, j)
    if op == "/" and j.kind == "int":
        return cast(f"({a} div {b})", t.INT8, j), j
    return f"({a} {op} {b})", j


def comparison(op: str, a: str, ta: Type, b: str, tb: Type) -> tuple[str, Type]:
    if not t.comparable(ta, tb):
        raise SemanticError(f"can't compare {ta} with {tb}")
    if op not in ("=", "!=") and t.BOOL in (ta, tb):
        raise SemanticError(f"{op} doesn't order booleans")
    return f"({a} {op} {b})", t.BOOL


def binary(op: str, a: str, ta: Type, b: str, tb: Type, compat_decimal: bool = False) -> tuple[str, Type]:
    if op in "+-*/%":
        return arithmetic(op, a, ta, b, tb, compat_decimal)
    if op in ("=", "!=", "<", "<=", ">", ">="):
        return comparison(op, a, ta, b, tb)
    if op in ("AND", "OR"):
        for x in (ta, tb):
            if x not in (t.BOOL, t.NULL):
                raise SemanticError(f"{op} needs booleans, not {x}")
        return f"({a} {op} {b})", t.BOOL
    for x in (ta, tb):
        if not x.string and x != t.NULL:
            raise SemanticError(f"{op} needs strings, not {x}")
    if op == "LIKE":
        return f"({a} LIKE {b})", t.BOOL
    return f"concat({a}, {b})", Type("char", ta.size + tb.size if ta.size and tb.size else 0)


def unary(op: str, a: str, ta: Type) -> tuple[str, Type]:
    if op == "NOT":
        if ta not in (t.BOOL, t.NULL):
            raise SemanticError(f"NOT needs a boolean, not {ta}")
        return f"(NOT {a})", t.BOOL
    if not ta.numeric and ta != t.NULL:
        raise SemanticError(f"unary {op} needs a number, not {ta}")
    if op == "~" and ta.kind != "int":
        raise SemanticError(f"~ needs an integer, not {ta}")
    return (a if op == "+" else f"({op} {a})"), ta


def scalar(fn: str, args: list[tuple[str, Type]]) -> tuple[str, Type]:
    if len(args) != 1:
        raise SemanticError(f"{fn} takes one argument")
    sql, ty = args[0]
    if fn == "ISNULL":
        return f"({sql} IS NULL)", t.BOOL
    if ty.string or ty in (t.DATE, t.DATETIME):
        raise SemanticError(f"INT() doesn't take {ty}")
    return f"CAST({sql} AS INT)", t.INT4


def aggregate(fn: str, sql: str | None, ty: Type | None) -> tuple[str, Type]:
    """``sql`` is None for COUNT(*)."""
    if fn == "COUNT":
        return f"COUNT({sql or '*'})", t.INT8
    if fn in ("MIN", "MAX"):
        if ty == t.BOOL:
            raise SemanticError(f"{fn} doesn't take BOOL")
        return f"{fn}({sql})", ty
    if not ty.numeric and ty != t.NULL:
        raise SemanticError(f"{fn} needs a number, not {ty}")
    if fn == "AVG":
        return f"AVG({cast(sql, ty, t.DOUBLE)})", t.DOUBLE
    if ty.kind == "int":
        return f"SUM({cast(sql, ty, t.INT8)})", t.INT8
    if ty.kind == "decimal":
        want = Type("decimal", 19, ty.scale)
        return f"CAST(SUM({sql}) AS {want.sql})", want
    return f"SUM({cast(sql, ty, t.DOUBLE)})", t.DOUBLE
