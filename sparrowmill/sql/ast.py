"""Syntax tree.  Positions don't take part in comparisons."""

from __future__ import annotations

from dataclasses import dataclass, field

from sparrowmill.types import Type

Pos = tuple[int, int]


@dataclass(frozen=True)
class Expr:
    pass


@dataclass(frozen=True)
class Name(Expr):
    prefix: str | None
    name: str
    pos: Pos = field(default=(0, 0), compare=False)

    def __str__(self):
        return f"{self.prefix}.{self.name}" if self.prefix else self.name


@dataclass(frozen=True)
class Const(Expr):
    kind: str  # int, float, string, date, datetime, bool, null
    value: object
    pos: Pos = field(default=(0, 0), compare=False)

    def __str__(self):
        if self.kind == "string":
            return '"' + self.value.replace("\\", "\\\\").replace('"', '\\"') + '"'
        if self.kind in ("date", "datetime"):
            return f"d'{self.value}'"
        return {"bool": str(self.value).upper(), "null": "NULL"}.get(self.kind, str(self.value))


@dataclass(frozen=True)
class Unary(Expr):
    op: str
    arg: Expr
    pos: Pos = field(default=(0, 0), compare=False)

    def __str__(self):
        return f"NOT {self.arg}" if self.op == "NOT" else f"{self.op}{self.arg}"


@dataclass(frozen=True)
class Binary(Expr):
    op: str
    left: Expr
    right: Expr
    pos: Pos = field(default=(0, 0), compare=False)

    def __str__(self):
        return f"({self.left} {self.op} {self.right})"


@dataclass(frozen=True)
class Call(Expr):
    fn: str
    args: tuple[Expr, ...]
    star: bool = False
    pos: Pos = field(default=(0, 0), compare=False)

    def __str__(self):
        return f"{self.fn}({'*' if self.star else ', '.join(map(str, self.args))})"


@dataclass(frozen=True)
class Subquery(Expr):
    select: "Select"
    pos: Pos = field(default=(0, 0), compare=False)

    def __str__(self):
        return "(SELECT ...)"


@dataclass(frozen=True)
class Source:
    what: "str | Select"
    alias: str
    pos: Pos = field(default=(0, 0), compare=False)


@dataclass(frozen=True)
class Select:
    star: bool
    items: tuple[tuple[Expr, str | None], ...]
    sources: tuple[Source, ...] = ()
    where: Expr | None = None
    group: tuple[tuple[Expr, str | None], ...] | None = None
    having: Expr | None = None
    order: tuple[tuple[Expr, bool], ...] = ()
    limit: tuple[int, int] | None = None
    pos: Pos = field(default=(0, 0), compare=False)


@dataclass(frozen=True)
class ColumnDef:
    name: str
    type: Type
    primary: bool = False
    not_null: bool = False
    unique: bool = False
    check: tuple[Expr, ...] = ()
    references: tuple[str, str] | None = None


@dataclass(frozen=True)
class CreateDatabase:
    name: str


@dataclass(frozen=True)
class DropDatabase:
    name: str
    if_exists: bool


@dataclass(frozen=True)
class UseDatabase:
    name: str


@dataclass(frozen=True)
class CreateTable:
    name: str
    columns: tuple[ColumnDef, ...]


@dataclass(frozen=True)
class DropTable:
    names: tuple[str, ...]
    if_exists: bool


@dataclass(frozen=True)
class CreateIndex:
    name: str | None
    table: str
    method: str
    fields: tuple[Expr, ...]
    unique: bool
    if_not_exists: bool


@dataclass(frozen=True)
class DropIndex:
    names: tuple[str, ...]
    if_exists: bool


@dataclass(frozen=True)
class Insert:
    table: str
    rows: tuple[tuple[object, ...], ...]  # Expr, "NULL" or "DEFAULT"


@dataclass(frozen=True)
class Update:
    table: str
    sets: tuple[tuple[str, Expr], ...]
    where: Expr | None


@dataclass(frozen=True)
class Delete:
    table: str
    where: Expr | None


@dataclass(frozen=True)
class Import:
    table: str
    path: str
    rows: int | None = None
    delimiter: str = ","
    escape: str = "\\"
    quote: str = '"'
    has_header: bool = False
    skip_header: bool = False


@dataclass(frozen=True)
class Instruction:
    name: str
    args: tuple[str, ...]
