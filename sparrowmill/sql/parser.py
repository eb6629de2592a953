"""Recursive-descent parser with precedence climbing for expressions."""

from __future__ import annotations

from sparrowmill import types as t
from sparrowmill.errors import EngineError, ParseError
from sparrowmill.sql import ast
from sparrowmill.sql.lexer import Token, tokens

#: Binding power of binary operators; NOT binds between comparisons and AND.
_POWER = {"*": 70, "/": 70, "%": 70, "+": 60, "-": 60, "..": 50, "<": 40, ">": 40, "<=": 40, ">=": 40, "=": 40, "!=": 40, "LIKE": 40, "AND": 20, "OR": 10}
_NOT = 30


def parse(text: str) -> list:
    """All statements of a text; empty ones are dropped."""
    return Parser(tokens(text)).statements()


class Parser:
    def __init__(self, toks: list[Token]) -> None:
        self.toks, self.at = toks, 0

    # ---- tokens

    @property
    def now(self) -> Token:
        return self.toks[self.at]

    def is_(self, *texts: str) -> bool:
        """The next tokens are these keywords or operators."""
        for k, x in enumerate(texts):
            i = min(self.at + k, len(self.toks) - 1)
            if self.toks[i].kind not in ("keyword", "op") or self.toks[i].text != x:
                return False
        return True

    def take(self, *texts: str) -> bool:
        if self.is_(*texts):
            self.at += len(texts)
            return True
        return False

    def need(self, *texts: str) -> None:
        for x in texts:
            if not self.take(x):
                raise ParseError(f"expected {x}, got {self.now.text or 'end of input'!r}", self.now.pos)

    def token(self, kind: str) -> Token:
        tok = self.now
        if tok.kind != kind:
            raise ParseError(f"expected {kind}, got {tok.text or 'end of input'!r}", tok.pos)
        self.at += 1
        return tok

    def name(self) -> str:
        return self.token("name").text

    def many(self, one) -> tuple:
        out = [one()]
        while self.take(","):
            out.append(one())
        return tuple(out)

    # ---- statements

    def statements(self) -> list:
        out = []
        while self.now.kind != "end":
            if self.take(";"):
                continue
            out.append(self.statement())
            self.need(";")
        return out

    def statement(self):
        tok = self.now
        if tok.kind == "instruction":
            self.at += 1
            if not tok.value:
                raise ParseError("instruction without a name", tok.pos)
            return ast.Instruction(tok.value[0], tuple(tok.value[1:]))
        if self.is_("SELECT"):
            return self.select()
        if self.take("CREATE"):
            if self.take("DATABASE"):
                return ast.CreateDatabase(self.name())
            if self.take("TABLE"):
                return self.create_table()
            return self.create_index()
        if self.take("DROP"):
            kind = self.now.text
            if not self.take("DATABASE") and not self.take("TABLE") and not self.take("INDEX"):
                raise ParseError(f"can't drop {kind!r}", self.now.pos)
            there = self.take("IF", "EXISTS")
            if kind == "DATABASE":
                return ast.DropDatabase(self.name(), there)
            return (ast.DropTable if kind == "TABLE" else ast.DropIndex)(self.many(self.name), there)
        if self.take("USE"):
            return ast.UseDatabase(self.name())
        if self.take("INSERT"):
            self.need("INTO")
            table = self.name()
            self.need("VALUES")
            return ast.Insert(table, self.many(self.row))
        if self.take("UPDATE"):
            table = self.name()
            self.need("SET")
            sets = self.many(self.assignment)
            return ast.Update(table, sets, self.expr() if self.take("WHERE") else None)
        if self.take("DELETE"):
            self.need("FROM")
            table = self.name()
            return ast.Delete(table, self.expr() if self.take("WHERE") else None)
        if self.take("IMPORT"):
            return self.import_()
        raise ParseError(f"expected a statement, got {tok.text or 'end of input'!r}", tok.pos)

    def assignment(self):
        name = self.name()
        self.need("=")
        return name, self.expr()

    def row(self):
        def value():
            for word in ("NULL", "DEFAULT"):
                if self.take(word):
                    return word
            return self.expr()

        self.need("(")
        out = self.many(value)
        self.need(")")
        return out

    def create_table(self):
        name = self.name()
        self.need("(")
        cols = self.many(self.column)
        self.need(")")
        return ast.CreateTable(name, cols)

    def column(self) -> ast.ColumnDef:
        name, kind = self.name(), self.type_()
        got: dict = {"check": ()}
        while True:
            if self.take("PRIMARY"):
                self.need("KEY")
                got |= {"primary": True, "not_null": True, "unique": True}
            elif self.take("NOT"):
                self.need("NULL")
                got["not_null"] = True
            elif self.take("UNIQUE"):
                got["unique"] = True
            elif self.take("CHECK"):
                self.need("(")
                got["check"] += (self.expr(),)
                self.need(")")
            elif self.take("REFERENCES"):
                table = self.name()
                self.need("(")
                got["references"] = (table, self.name())
                self.need(")")
            else:
                return ast.ColumnDef(name, kind, **got)

    def type_(self) -> t.Type:
        tok = self.now
        plain = {"BOOL": t.BOOL, "FLOAT": t.FLOAT, "DOUBLE": t.DOUBLE, "DATE": t.DATE, "DATETIME": t.DATETIME}
        if tok.kind != "keyword":
            raise ParseError(f"expected a type, got {tok.text!r}", tok.pos)
        self.at += 1
        if tok.text in plain:
            return plain[tok.text]
        if tok.text not in ("CHAR", "VARCHAR", "INT", "DECIMAL"):
            raise ParseError(f"expected a type, got {tok.text!r}", tok.pos)
        self.need("(")
        n = self.token("int").value
        if tok.text == "DECIMAL":
            s = self.token("int").value if self.take(",") else 0
            made = lambda: t.decimal(n, s)
        elif tok.text == "INT":
            made = lambda: t.integer(n)
        else:
            if n <= 0:
                raise ParseError("a string type needs a positive length", tok.pos)
            made = lambda: t.Type(tok.text.lower(), n)
        self.need(")")
        try:
            return made()
        except EngineError as e:
            raise ParseError(str(e), tok.pos) from None

    def create_index(self):
        unique = self.take("UNIQUE")
        self.need("INDEX")
        there = self.take("IF", "NOT", "EXISTS")
        name = None if self.is_("ON") and not there else self.name()
        self.need("ON")
        table, method = self.name(), "DEFAULT"
        if self.take("USING") and not self.take("DEFAULT"):
            method = self.name()

        def key():
            if self.take("("):
                e = self.expr()
                self.need(")")
                return e
            tok = self.token("name")
            return ast.Name(None, tok.text, tok.pos)

        self.need("(")
        fields = self.many(key)
        self.need(")")
        return ast.CreateIndex(name, table, method, fields, unique, there)

    def import_(self):
        self.need("INTO")
        table = self.name()
        if not self.take("DSV"):
            raise ParseError("unrecognised input format", self.now.pos)
        got: dict = {"table": table, "path": self.token("string").value}
        if self.take("ROWS"):
            got["rows"] = self.token("int").value
        for word in ("DELIMITER", "ESCAPE", "QUOTE"):
            if self.take(word):
                tok = self.token("string")
                if len(tok.value) != 1:
                    raise ParseError(f"{word} must be one character", tok.pos)
                got[word.lower()] = tok.value
        if self.take("HAS"):
            self.need("HEADER")
            got["has_header"] = True
        if self.take("SKIP"):
            self.need("HEADER")
            got |= {"skip_header": True, "has_header": True}
        if got.get("delimiter", ",") == got.get("quote", '"'):
            raise ParseError("delimiter and quote must differ", self.now.pos)
        return ast.Import(**got)

    # ---- select

    def select(self) -> ast.Select:
        pos = self.now.pos
        self.need("SELECT")
        star = self.take("*")
        items: tuple = ()
        if not star or self.take(","):
            items = self.many(self.item)
        sources = self.many(self.source) if self.take("FROM") else ()
        where = self.expr() if self.take("WHERE") else None
        group = having = limit = None
        if self.take("GROUP"):
            self.need("BY")
            group = self.many(self.item)
        if self.take("HAVING"):
            having = self.expr()
        order: tuple = ()
        if self.take("ORDER"):
            self.need("BY")
            order = self.many(self.sort_key)
        if self.take("LIMIT"):
            n = self.token("int").value
            limit = (n, self.token("int").value if self.take("OFFSET") else 0)
        return ast.Select(star, items, sources, where, group, having, order, limit, pos)

    def item(self):
        e = self.expr()
        if self.take("AS") or self.now.kind == "name":
            return e, self.name()
        return e, None

    def sort_key(self):
        e = self.expr()
        desc = self.take("DESC")
        if not desc:
            self.take("ASC")
        return e, not desc

    def source(self) -> ast.Source:
        pos = self.now.pos
        if self.take("("):
            what = self.select()
            self.need(")")
            self.take("AS")
            return ast.Source(what, self.name(), pos)
        table = self.name()
        if self.take("AS") or self.now.kind == "name":
            return ast.Source(table, self.name(), pos)
        return ast.Source(table, table, pos)

    # ---- expressions

    def expr(self, power: int = 0) -> ast.Expr:
        tok = self.now
        if self.take("NOT"):
            left: ast.Expr = ast.Unary("NOT", self.expr(_NOT), tok.pos)
        elif tok.kind == "op" and tok.text in ("+", "-", "~"):
            self.at += 1
            left = ast.Unary(tok.text, self.expr(80), tok.pos)
        else:
            left = self.postfix()
        while self.now.kind in ("op", "keyword") and (p := _POWER.get(self.now.text, 0)) > power:
            op = self.now
            self.at += 1
            left = ast.Binary(op.text, left, self.expr(p), op.pos)
        return left

    def postfix(self) -> ast.Expr:
        tok = self.now
        if tok.kind in ("int", "float", "string", "date", "datetime"):
            self.at += 1
            return ast.Const(tok.kind, tok.value, tok.pos)
        for word, kind, value in (("TRUE", "bool", True), ("FALSE", "bool", False), ("NULL", "null", None)):
            if self.take(word):
                return ast.Const(kind, value, tok.pos)
        if self.take("("):
            if self.is_("SELECT"):
                e: ast.Expr = ast.Subquery(self.select(), tok.pos)
            else:
                e = self.expr()
            self.need(")")
            return e
        if self.is_("INT", "("):  # the documented cast; INT is a keyword everywhere else
            self.at += 1
            return self.call("INT", tok.pos)
        name = self.name()
        if self.is_("("):
            return self.call(name, tok.pos)
        if self.take("."):
            return ast.Name(name, self.name(), tok.pos)
        return ast.Name(None, name, tok.pos)

    def call(self, fn: str, pos) -> ast.Call:
        self.need("(")
        if self.take("*"):
            self.need(")")
            return ast.Call(fn, (), True, pos)
        args = () if self.is_(")") else self.many(self.expr)
        self.need(")")
        return ast.Call(fn, args, False, pos)
