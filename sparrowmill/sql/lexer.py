"""Tokens of the dialect."""

from __future__ import annotations

import re
from dataclasses import dataclass

from sparrowmill.errors import LexError

#: The dialect's keywords, spelled exactly so.
KEYWORDS = frozenset(
    """AND AS ASC BOOL BY CASCADE CHAR CHECK CREATE DATABASE DATE DATETIME DECIMAL DEFAULT DELETE DELIMITER DESC DOUBLE DROP
    DSV ESCAPE EXISTS FALSE FLOAT FROM GROUP HAS HAVING HEADER IF IMPORT INDEX INSERT INT INTO KEY LIKE LIMIT NOT NULL OFFSET ON OR ORDER
    PRIMARY QUOTE REFERENCES RESTRICT ROWS SELECT SET SKIP TABLE TRUE UNIQUE UPDATE USE USING VALUES VARCHAR WHERE""".split()
)

_SCAN = re.compile(
    r"""(?P<space>\s+|--[^\n]*)
      | (?P<instruction>\\[^;]*)
      | (?P<datetime>d'(?P<dt>[^'\n]*)'?)
      | (?P<hexfloat>0[xX](?:[0-9a-fA-F]*\.[0-9a-fA-F]+|[0-9a-fA-F]+\.(?!\.))(?:[pP][+-]?\d+)?|0[xX][0-9a-fA-F]+[pP][+-]?\d+)
      | (?P<hex>0[xX][0-9a-fA-F]+)
      | (?P<float>(?:\d+\.\d+|\.\d+|\d+\.(?!\.))(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+)
      | (?P<int>\d+)
      | (?P<word>[A-Za-z_][A-Za-z0-9_]*)
      | (?P<string>"(?:[^"\\\n]|\\.)*"?)
      | (?P<op>\.\.|!=|<=|>=|[()~+\-*/%=<>,;.])""",
    re.X,
)
_ESCAPES = {'"': '"', "\\": "\\", "n": "\n", "t": "\t"}


@dataclass(frozen=True)
class Token:
    kind: str  # keyword, name, int, float, string, date, datetime, op, instruction, end
    text: str
    value: object
    pos: tuple[int, int]


def _string(raw: str, pos) -> str:
    if len(raw) < 2 or raw[-1] != '"' or re.search(r"(?<!\\)(?:\\\\)*\\\"$", raw):
        raise LexError("string literal without end", pos)

    def escape(m):
        if m[1] not in _ESCAPES:
            raise LexError(f"invalid escape sequence \\{m[1]}", pos)
        return _ESCAPES[m[1]]

    return re.sub(r"\\(.)", escape, raw[1:-1])


def tokens(text: str) -> list[Token]:
    out, at, line, start = [], 0, 1, 0
    while at < len(text):
        pos = (line, at - start + 1)
        m = _SCAN.match(text, at)
        if not m:
            raise LexError(f"illegal character {text[at]!r}", pos)
        kind, raw = m.lastgroup if m.lastgroup != "dt" else "datetime", m[0]
        at = m.end()
        if kind == "space":
            line += raw.count("\n")
            if "\n" in raw:
                start = m.start() + raw.rindex("\n") + 1
            continue
        if kind in ("int", "hex", "float", "hexfloat") and at < len(text) and (text[at].isalnum() or text[at] == "_"):
            raise LexError(f"invalid number {raw + text[at]!r}", pos)
        value: object = raw
        if kind == "word":
            kind = "keyword" if raw in KEYWORDS else "name"
        elif kind == "int":
            if len(raw) > 1 and raw[0] == "0":
                if set(raw) - set("01234567"):
                    raise LexError(f"invalid octal number {raw}", pos)
                value = int(raw, 8)
            else:
                value = int(raw)
        elif kind == "hex":
            kind, value = "int", int(raw, 16)
        elif kind in ("float", "hexfloat"):
            value, kind = (float.fromhex(raw) if kind == "hexfloat" else float(raw)), "float"
        elif kind == "string":
            value = _string(raw, pos)
            line += raw.count("\n")
        elif kind == "datetime":
            if not raw.endswith("'") or len(raw) < 3:
                raise LexError("date literal without end", pos)
            value = m["dt"]
            if re.fullmatch(r"-?\d{4,}-\d\d-\d\d", value):
                kind = "date"
            elif not re.fullmatch(r"-?\d{4,}-\d\d-\d\d \d\d:\d\d:\d\d", value):
                raise LexError(f"invalid date literal {raw}", pos)
        elif kind == "instruction":
            value = raw[1:].split()
        out.append(Token(kind, raw, value, pos))
    out.append(Token("end", "", None, (line, at - start + 1)))
    return out
