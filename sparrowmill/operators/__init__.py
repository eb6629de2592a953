"""The algebra's operators as DataFrame functions, for programs that don't write SQL.

Each says which Spark operator it stands for; strategies are hints, so Catalyst can still overrule what can't work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Join strategies and Spark's hints.  "nested_loop" is for conditions without an equality.
STRATEGIES = {"hash": "shuffle_hash", "merge": "merge", "broadcast": "broadcast", "nested_loop": "shuffle_replicate_nl"}


def scan(df: DataFrame, alias: str, hidden: tuple[str, ...] = ()) -> DataFrame:
    """All visible columns, qualified by the alias."""
    return df.drop(*hidden).alias(alias)


def filter_(df: DataFrame, *clauses: Column) -> DataFrame:
    """Rows for which every clause is true (not null)."""
    for c in clauses:
        df = df.filter(c)
    return df


def disjunctive_filter(df: DataFrame, *disjuncts: Column) -> DataFrame:
    """Rows for which some disjunct is true."""
    out = F.lit(False)
    for d in disjuncts:
        out = out | d
    return df.filter(out)


def join(left: DataFrame, right: DataFrame, on: Column | None, strategy: str | None = None) -> DataFrame:
    """Inner join; without a condition, the product."""
    if strategy is not None:
        right = right.hint(STRATEGIES[strategy])
    return left.crossJoin(right) if on is None else left.join(right, on, "inner")


def grouping(df: DataFrame, keys: list[Column], aggregates: list[Column]) -> DataFrame:
    """A row for each distinct combination of keys, NULL being one; without aggregates, the distinct keys."""
    return df.groupBy(*keys).agg(*aggregates) if aggregates else df.select(*keys).distinct()


def aggregation(df: DataFrame, aggregates: list[Column]) -> DataFrame:
    """Exactly one row, also of an empty input."""
    return df.agg(*aggregates)


def group_join(left: DataFrame, right: DataFrame, on: Column, keys: list[Column], aggregates: list[Column]) -> DataFrame:
    """Join and group by the join's keys; as a merge join, the grouping needs no exchange of its own."""
    return join(left, right, on, "merge").groupBy(*keys).agg(*aggregates)


def sorting(df: DataFrame, by: list[tuple[Column, bool]]) -> DataFrame:
    """Sort; NULL comes first in either direction."""
    return df.orderBy(*(c.asc_nulls_first() if asc else c.desc_nulls_first() for c, asc in by))


def limit(df: DataFrame, n: int, offset: int = 0) -> DataFrame:
    return (df.offset(offset) if offset else df).limit(n)


def point_scan(df: DataFrame, attribute: str, value) -> DataFrame:
    """Rows with a value; pushed down to the files' row groups."""
    return df.filter(F.col(attribute) == F.lit(value))


def range_scan(df: DataFrame, attribute: str, low=None, high=None, low_open: bool = False, high_open: bool = False) -> DataFrame:
    """Rows within one- or two-sided bounds; pushed down to the files' row groups."""
    c = F.col(attribute)
    if low is not None:
        df = df.filter(c > F.lit(low) if low_open else c >= F.lit(low))
    if high is not None:
        df = df.filter(c < F.lit(high) if high_open else c <= F.lit(high))
    return df
