"""Conjunctive normal form of conditions: NOT is pushed down, then OR is distributed over AND."""

from __future__ import annotations

from sparrowmill.sql.ast import Binary, Expr, Unary

_NEGATED = {"=": "!=", "!=": "=", "<": ">=", ">=": "<", ">": "<=", "<=": ">"}
#: A condition whose form would have more clauses than this stays one clause.
MOST = 64


def push_not(e: Expr, negate: bool = False) -> Expr:
    if isinstance(e, Unary) and e.op == "NOT":
        return push_not(e.arg, not negate)
    if isinstance(e, Binary) and e.op in ("AND", "OR"):
        op = {"AND": "OR", "OR": "AND"}[e.op] if negate else e.op
        return Binary(op, push_not(e.left, negate), push_not(e.right, negate), e.pos)
    if negate and isinstance(e, Binary) and e.op in _NEGATED:
        return Binary(_NEGATED[e.op], e.left, e.right, e.pos)
    return Unary("NOT", e) if negate else e


def clauses(e: Expr) -> list[list[Expr]]:
    """Clauses, each a list of disjuncts."""
    e = push_not(e)

    def form(x: Expr) -> list[list[Expr]]:
        if isinstance(x, Binary) and x.op == "AND":
            return form(x.left) + form(x.right)
        if isinstance(x, Binary) and x.op == "OR":
            a, b = form(x.left), form(x.right)
            if len(a) * len(b) > MOST:
                return [[x]]
            return [p + [q for q in r if q not in p] for p in a for r in b]
        return [[x]]

    out: list[list[Expr]] = []
    for c in form(e):
        if c not in out:
            out.append(c)
    return out
