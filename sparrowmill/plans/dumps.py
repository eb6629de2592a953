"""Syntax trees and plans as text and for Graphviz."""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

from pyspark.sql import DataFrame


def _inner(x) -> bool:
    """Whether something has children: a node of the syntax tree, or a list."""
    return isinstance(x, (list, tuple)) or (dataclasses.is_dataclass(x) and type(x).__module__.endswith("sql.ast"))


def _walk(node, label: str, depth: int) -> Iterator[tuple[int, str]]:
    """(depth, text) of a node and all below it; a list without a name of its own adds no depth."""
    if not _inner(node):
        yield depth, ": ".join(x for x in (label, str(node)) if x)
        return
    own, below = [], []
    if dataclasses.is_dataclass(node):
        own = [type(node).__name__]
        for f in dataclasses.fields(node):
            v = getattr(node, f.name)
            if f.name == "pos" or v is None or v == () or v == []:
                continue
            if _inner(v):
                below.append((f.name, v))
            else:
                own.append(f"{f.name}={v}")
    else:
        below = [("", x) for x in node if x is not None]
    text = ": ".join(x for x in (label, " ".join(own)) if x)
    if text:
        yield depth, text
    for name, child in below:
        yield from _walk(child, name, depth + bool(text))


def tree(statement) -> str:
    """One line a node, children indented."""
    return "\n".join("  " * depth + text for depth, text in _walk(statement, "", 0))


def tree_dot(statement) -> str:
    return _dot(_walk(statement, "", 0))


def plan_dot(df: DataFrame) -> str:
    """The optimised plan of a DataFrame, for Graphviz."""

    def walk(node, depth: int) -> Iterator[tuple[int, str]]:
        yield depth, node.simpleString(12)
        below = node.children()
        for k in range(below.size()):
            yield from walk(below.apply(k), depth + 1)

    return _dot(walk(df._jdf.queryExecution().optimizedPlan(), 0))


def _dot(lines) -> str:
    """A graph from (depth, text) in preorder."""
    out, path = ["digraph {", "  node [shape=box];"], {}
    for k, (depth, text) in enumerate(lines):
        shown = text.replace("\\", "\\\\").replace('"', '\\"')
        out.append(f'  n{k} [label="{shown}"];')
        above = [d for d in path if d < depth]
        if above:
            out.append(f"  n{path[max(above)]} -> n{k};")
        path = {d: n for d, n in path.items() if d < depth} | {depth: k}
    return "\n".join([*out, "}"])
