"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is joins and minima over (node, node) rows; no neighbourhood is gathered in one place, and a node with very many
neighbours is a skewed join, which adaptive execution splits.  Each step is written to scratch, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowmill.llm.common import Scratch


def _large(e: DataFrame, scratch: Scratch, name: str, upto: int) -> DataFrame:
    both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    m = scratch.cut(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), name, upto)
    return both.filter("v > u").join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")


def _small(e: DataFrame, scratch: Scratch, name: str, upto: int) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    m = scratch.cut(down.groupBy("u").agg(F.min("v").alias("m")), name, upto)
    moved = down.join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(m.select("u", F.col("m").alias("v"))).filter("u != v").distinct()


def _flat(e: DataFrame) -> bool:
    """Whether every node has one edge, to a node that has none of its own: the edges are the result then."""
    if not e.groupBy("u").count().filter("count > 1").isEmpty():
        return False
    return e.join(e.select(F.col("v").alias("u")), "u", "left_semi").isEmpty()


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """``edges``: (u, v) of orderable ids.  Returns (node, component), the component being the smallest node; only nodes with edges.  Without edges, no rows."""
    e = edges.filter("u != v").select("u", "v")
    k, upto = 0, 64 * e.count()  # bytes; a step at most doubles the edges
    while True:
        k += 1
        large = scratch.cut(_large(e, scratch, f"{name}-l{k}", upto), f"{name}-large{k}", upto)
        e = scratch.cut(_small(large, scratch, f"{name}-s{k}", upto), f"{name}-{k}", upto)
        scratch.drop(f"{name}-{k - 1}", f"{name}-l{k}", f"{name}-s{k}", f"{name}-large{k}")
        if _flat(e):
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
