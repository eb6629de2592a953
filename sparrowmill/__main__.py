"""Command line: statements of files, or of the standard input, over Parquet tables.

    python -m sparrowmill --table orders=/data/orders.parquet --graph --times query.sql
"""

from __future__ import annotations

import argparse
import sys
import time
from typing import TextIO

from pyspark.sql import SparkSession

from sparrowmill.errors import EngineError
from sparrowmill.plans import dumps
from sparrowmill.plans.joinorder import ENUMERATORS
from sparrowmill.session import Engine
from sparrowmill.sources import sinks
from sparrowmill.sql import ast
from sparrowmill.sql.parser import parse

#: What is shown of a SELECT, in this order, by flag.
SHOWN = ("graph", "graphdot", "graph2sql", "plan", "plandot", "physplan")


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("sparrowmill", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("files", nargs="*", default=["-"], help="files of statements, in order; - is the standard input")
    p.add_argument("--table", action="append", default=[], metavar="NAME=PATH", help="a Parquet table of the database main")
    p.add_argument("-q", "--quiet", action="store_true", help="drop the results of queries")
    p.add_argument("-t", "--times", action="store_true", help="seconds of each statement")
    p.add_argument("-s", "--statistics", action="store_true", help="rows of each result")
    p.add_argument("--echo", action="store_true", help="the kind of each statement")
    p.add_argument("--ast", action="store_true", help="syntax trees")
    p.add_argument("--astdot", action="store_true", help="syntax trees, for Graphviz")
    for name, text in zip(SHOWN, ("query graphs", "query graphs, for Graphviz", "queries as they are planned, in SQL", "optimised plans", "optimised plans, for Graphviz", "physical plans")):
        p.add_argument(f"--{name}", action="store_true", help=text)
    p.add_argument("--dryrun", action="store_true", help="plan queries and don't run them")
    p.add_argument("--plan-enumerator", choices=sorted(ENUMERATORS), help="enumerator of join orders; Spark's own order without")
    p.add_argument("--join-hint", choices=("BROADCAST", "MERGE", "SHUFFLE_HASH", "SHUFFLE_REPLICATE_NL"))
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out: TextIO | None = None) -> int:
    """Runs the statements; returns 1 if one of them is wrong, and then none after it is run."""
    o, out = arguments().parse_args(argv), out or sys.stdout
    own = spark is None
    spark = spark or SparkSession.builder.appName("sparrowmill").getOrCreate()
    e = Engine(spark, enumerator=o.plan_enumerator, join_hint=o.join_hint)
    try:
        for given in o.table:
            name, _, path = given.partition("=")
            e.register(name, spark.read.parquet(path))
        for path in o.files:
            if path == "-":
                text = sys.stdin.read()
            else:
                with open(path) as f:
                    text = f.read()
            for s in parse(text):
                _statement(e, s, o, out)
    except (EngineError, OSError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 1
    finally:
        e.close()
        if own:
            spark.stop()
    return 0


def _statement(e: Engine, s, o: argparse.Namespace, out: TextIO) -> None:
    began = time.perf_counter()
    if o.echo:
        print(f"-- {type(s).__name__}", file=out)
    if o.ast:
        print(dumps.tree(s), file=out)
    if o.astdot:
        print(dumps.tree_dot(s), file=out)
    if isinstance(s, ast.Select):
        for mode in SHOWN:
            if getattr(o, mode):
                print(e.explain(s, {"plan": "extended", "physplan": "formatted"}.get(mode, mode)), file=out)
    if not (o.dryrun and isinstance(s, ast.Select)):
        df = e.run(s)
        if df is not None:
            rows = sinks.dropped(df) if o.quiet else 0
            if not o.quiet:
                for rows, line in enumerate(sinks.lines(df), 1):
                    print(line, file=out)
            if o.statistics:
                print(f"-- {rows} rows", file=out)
    if o.times:
        print(f"-- {type(s).__name__}: {time.perf_counter() - began:.3f} s", file=out)


if __name__ == "__main__":
    sys.exit(main())
