"""What becomes of a result: printed, handed over row by row, or dropped."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T


def number(c: Column, digits: int) -> Column:
    """A floating-point number with so many significant digits, without trailing zeros, with an exponent if it is below -4 or no less than ``digits``."""
    sci = F.format_string(f"%.{digits - 1}e", c.cast("double"))
    exp = F.regexp_extract(sci, r"e([+-]\d+)$", 1).cast("int")
    own = F.regexp_replace(F.regexp_extract(sci, r"^-?([0-9.]+)", 1), r"\.", "")
    bare = lambda s: F.regexp_replace(F.regexp_replace(s, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    large = F.concat(F.substring(own, F.lit(1), exp + 1), F.lit("."), F.substring(own, exp + 2, F.lit(digits)))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exp - 1), own)
    science = F.concat(bare(F.concat(F.substring(own, 1, 1), F.lit("."), F.substring(own, 2, digits))), F.lit("e"), F.regexp_extract(sci, r"e([+-]\d+)$", 1))
    text = F.when((exp < -4) | (exp >= digits), science).when(exp >= 0, bare(large)).otherwise(bare(small))
    signed = F.concat(F.when(sci.startswith("-"), "-").otherwise(""), text)
    return F.when(c.isNull(), None).when(F.isnan(c), "nan").when(F.abs(c) == float("inf"), F.when(c > 0, "inf").otherwise("-inf")).otherwise(signed)


def printed(df: DataFrame) -> DataFrame:
    """One string column: each row as comma-separated values, strings in double quotes, NULL as NULL.  Dates of any era are rendered by Spark."""
    cells = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            c = F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
        elif isinstance(f.dataType, T.BooleanType):
            c = F.upper(c.cast("string"))
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = number(c, 8 if isinstance(f.dataType, T.FloatType) else 16)
        else:
            c = c.cast("string")
        cells.append(F.coalesce(c, F.lit("NULL")))
    return df.select(F.concat_ws(",", *cells).alias("row"))


def lines(df: DataFrame) -> Iterator[str]:
    """The printed rows, fetched partition by partition."""
    return (r[0] for r in printed(df).toLocalIterator())


def each(df: DataFrame, callback: Callable[[Row], None]) -> int:
    """Hand every row to a callback on the driver, partition by partition; returns their number."""
    n = 0
    for n, row in enumerate(df.toLocalIterator(), 1):  # noqa: B007
        callback(row)
    return n


def windows(df: DataFrame, size: int) -> Iterator[list[Row]]:
    """The result in windows of ``size`` rows."""
    held: list[Row] = []
    for row in df.toLocalIterator():
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def dropped(df: DataFrame) -> int:
    """Compute everything, keep nothing; returns the number of rows (counted on the way)."""
    from pyspark.sql import Observation

    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.format("noop").mode("overwrite").save()
    return seen.get["rows"]
