"""The dialect's types, how they join in arithmetic and compare, and their Spark counterparts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

from sparrowmill.errors import SemanticError


@dataclass(frozen=True)
class Type:
    """``kind``: bool, char, varchar, int, float, double, decimal, date, datetime, null.

    ``size``: characters of strings (0: unbounded), bytes of integers, digits of decimals."""

    kind: str
    size: int = 0
    scale: int = 0

    @property
    def numeric(self) -> bool:
        return self.kind in ("int", "float", "double", "decimal")

    @property
    def string(self) -> bool:
        return self.kind in ("char", "varchar")

    @property
    def bits(self) -> int:
        if self.kind == "decimal":
            need = -(-self.size * 332 // 100)
            return 1 << max(0, need - 1).bit_length()
        return {"int": 8 * self.size, "float": 32, "double": 64}[self.kind]

    def __str__(self) -> str:
        if self.kind in ("char", "varchar", "int"):
            return f"{self.kind.upper()}({self.size})" if self.size else self.kind.upper()
        if self.kind == "decimal":
            return f"DECIMAL({self.size}, {self.scale})"
        return self.kind.upper()

    @property
    def sql(self) -> str:
        """Spark's name of it."""
        if self.kind == "int":
            return {1: "TINYINT", 2: "SMALLINT", 4: "INT", 8: "BIGINT"}[self.size]
        if self.kind == "decimal":
            return f"DECIMAL({min(self.size, 38)},{self.scale})"
        return {"bool": "BOOLEAN", "char": "STRING", "varchar": "STRING", "float": "FLOAT", "double": "DOUBLE", "date": "DATE", "datetime": "TIMESTAMP_NTZ", "null": "VOID"}[self.kind]


BOOL, FLOAT, DOUBLE, DATE, DATETIME, NULL = (Type(k) for k in ("bool", "float", "double", "date", "datetime", "null"))
INT1, INT2, INT4, INT8 = (Type("int", n) for n in (1, 2, 4, 8))


def integer(n: int) -> Type:
    if n not in (1, 2, 4, 8):
        raise SemanticError(f"INT({n}) has no representation; use 1, 2, 4 or 8 bytes")
    return Type("int", n)


def decimal(p: int, s: int = 0) -> Type:
    if not 0 < p <= 38 or not 0 <= s <= p:
        raise SemanticError(f"DECIMAL({p}, {s}) is not a valid type")
    return Type("decimal", p, s)


def arithmetic_join(a: Type, b: Type) -> Type:
    """The type of an arithmetic operation's result: integers by width, then floats by bits, then decimals by digits and scale."""
    if not (a.numeric and b.numeric):
        raise SemanticError(f"arithmetic needs numbers, not {a} and {b}")
    if "decimal" in (a.kind, b.kind):
        digits = lambda t: t.size if t.kind == "decimal" else {"int": {1: 3, 2: 5, 4: 10, 8: 19}.get(t.size, 19), "float": 7, "double": 16}[t.kind]
        scale = max(a.scale, b.scale)
        return Type("decimal", min(38, max(digits(a), digits(b), scale + 1)), scale)
    if a.kind == b.kind == "int":
        return a if a.size >= b.size else b
    return FLOAT if max(a.bits, b.bits) <= 32 else DOUBLE


def comparable(a: Type, b: Type) -> bool:
    if NULL in (a, b):
        return True
    return (a.numeric and b.numeric) or (a.string and b.string) or (a.kind == b.kind and a.kind in ("bool", "date", "datetime"))


def from_spark(t: T.DataType) -> Type:
    plain = {T.BooleanType: BOOL, T.ByteType: INT1, T.ShortType: INT2, T.IntegerType: INT4, T.LongType: INT8, T.FloatType: FLOAT, T.DoubleType: DOUBLE, T.DateType: DATE, T.TimestampNTZType: DATETIME, T.TimestampType: DATETIME, T.NullType: NULL}
    if isinstance(t, T.DecimalType):
        return Type("decimal", t.precision, t.scale)
    if isinstance(t, T.StringType):
        return Type("varchar")
    if type(t) in plain:
        return plain[type(t)]
    raise SemanticError(f"columns of type {t.simpleString()} have no counterpart in the dialect")


def to_spark(t: Type) -> T.DataType:
    if t.kind == "decimal":
        return T.DecimalType(t.size, t.scale)
    if t.kind == "int":
        return {1: T.ByteType(), 2: T.ShortType(), 4: T.IntegerType(), 8: T.LongType()}[t.size]
    return {"bool": T.BooleanType(), "char": T.StringType(), "varchar": T.StringType(), "float": T.FloatType(), "double": T.DoubleType(), "date": T.DateType(), "datetime": T.TimestampNTZType(), "null": T.NullType()}[t.kind]
