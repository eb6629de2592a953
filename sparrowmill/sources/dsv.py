"""Delimiter-separated values: Spark's CSV reader for the cells, typed conversions for their contents.

An empty cell is NULL, a quoted empty string is a string.  A cell that its column's type can't hold is NULL.  Rows with a wrong number
of cells are dropped and don't count towards a row limit.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparrowmill.errors import SemanticError
from sparrowmill.types import Type


#: Stands for a quoted empty string between the reader and the conversion; no file has it, as it is made anew in every process.
_EMPTY = f"\x01{uuid.uuid4().hex}"


def convert(cell: Column, ty: Type) -> Column:
    """A cell's text as a value of the type, else NULL."""
    if ty.string:
        cell = F.when(cell == _EMPTY, "").otherwise(cell)
        return F.substring(cell, 1, ty.size) if ty.size else cell
    if ty.kind == "bool":
        return F.when(cell == "TRUE", True).when(cell == "FALSE", False)
    if ty.kind == "int":
        return F.when(cell.rlike(r"^[+-]?[0-9]+$"), cell.try_cast(ty.sql))
    if ty.kind == "decimal":  # digits beyond the scale are cut off, not rounded
        cut = F.regexp_extract(cell, rf"^([+-]?[0-9]*(?:\.[0-9]{{0,{ty.scale}}})?)", 1) if ty.scale else F.regexp_extract(cell, r"^([+-]?[0-9]*)", 1)
        return F.when(cell.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)$"), cut.try_cast(ty.sql))
    if ty.kind in ("float", "double"):
        v = cell.try_cast("double")
        most = 3.4028234663852886e38 if ty.kind == "float" else 1.7976931348623157e308
        return F.when(v > most, F.lit(most)).when(v < -most, F.lit(-most)).otherwise(v).cast(ty.sql)
    bare = F.regexp_replace(cell, r"^d?'(.*)'$", "$1")
    pattern = r"^-?[0-9]{4,}-[0-9]{2}-[0-9]{2}" + (r"$" if ty.kind == "date" else r" [0-9]{2}:[0-9]{2}:[0-9]{2}$")
    return F.when(bare.rlike(pattern), bare.try_cast(ty.sql))


def read(spark: SparkSession, path: str, columns: list[tuple[str, Type]], rows: int | None = None, delimiter: str = ",", escape: str = "\\", quote: str = '"', has_header: bool = False, skip_header: bool = False) -> DataFrame:
    """A file's rows as a table of the given columns.  With a header that isn't skipped, cells are found by the header's names; names that the table lacks are passed over."""
    names = [n for n, _ in columns]
    cells = names
    if has_header and not skip_header:
        first = spark.read.option("sep", delimiter).option("quote", quote).option("escape", escape).option("header", "true").csv(path).columns
        cells = [c if c in names else f"#{i}" for i, c in enumerate(first)]
        if not set(cells) & set(names):
            raise SemanticError(f"no column of {path} is in the table")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in cells])
    raw = spark.read.schema(schema).options(sep=delimiter, quote=quote, escape=escape, header=str(has_header or skip_header).lower(), enforceSchema="true", mode="DROPMALFORMED", columnPruning="false", emptyValue=_EMPTY, nullValue="", multiLine="false").csv(path)
    if rows is not None:
        raw = raw.limit(rows)
    return raw.select(*(convert(F.col(f"`{n}`"), ty).alias(n) if n in cells else F.lit(None).cast(ty.sql).alias(n) for n, ty in columns))


def write(df: DataFrame, path: str, delimiter: str = ",", header: bool = True) -> None:
    """Write a table so that ``read`` gives it back: strings quoted, NULL as an empty cell."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            c = F.when(c.isNotNull(), c)
        elif isinstance(f.dataType, T.BooleanType):
            c = F.upper(c.cast("string"))
        elif isinstance(f.dataType, (T.TimestampNTZType, T.TimestampType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        else:
            c = c.cast("string")
        cols.append(c.alias(f.name))
    df.select(*cols).write.mode("overwrite").options(sep=delimiter, header=str(header).lower(), quote='"', escape="\\", emptyValue='""', nullValue="").csv(path)
