"""The dialect over streams: a streaming DataFrame can be a table of the engine, and a query over it is run in micro-batches.

Filters, projections and joins with static tables run in append mode, grouped queries in complete mode; what Structured Streaming
can't do incrementally (sorting without grouping, say) fails as it says."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from sparrowmill.session import Engine
from sparrowmill.sql import ast
from sparrowmill.sql.binder import has_aggregate
from sparrowmill.sql.parser import parse


def continuous(engine: Engine, text: str, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run a SELECT over registered streaming tables; ``sink`` gets each micro-batch's result and its number."""
    (select,) = parse(text if text.rstrip().endswith(";") else text + ";")
    grouped = isinstance(select, ast.Select) and (select.group is not None or select.having is not None or any(has_aggregate(e) for e, _ in select.items))
    return engine.sql(select).writeStream.outputMode("complete" if grouped else "append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
