"""A small SQL dialect as nested tuples: statements, joins and expressions with ANSI operator precedence.

Expressions: ("lit", value, kind), ("col", qualifier or None, name), ("bin", op, a, b), ("neg", a), ("call", name, args), ("star",).
"""

import re
from dataclasses import dataclass, field

TOKEN = re.compile(r"\s*(?:('[^']*'|\"[^\"]*\")|(\d+\.\d*|\.\d+|\d+)|([^\W\d]\w*)|(<=|>=|!=|<>|==|&&|\|\||[-+*/=<>(),.;\[\]]))")
RESERVED = set("select distinct from where group by having order limit offset join inner left right full outer cross on using and or as asc desc set values into".split())


class SqlError(ValueError):
    pass


def tokenize(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise SqlError(f"unexpected character at {text[at : at + 20]!r}")
        kind = ("str", "num", "id", "op")[next(i for i, g in enumerate(m.groups()) if g is not None)]
        value = m.group(m.lastindex)
        out.append((kind, value[1:-1] if kind == "str" else value))
        at = m.end()
    return out


@dataclass
class Select:
    items: list  # (expression, alias or None)
    table: str
    alias: str | None
    joins: list = field(default_factory=list)  # (kind, table, alias, on expression or None, using columns)
    distinct: bool = False
    where: tuple | None = None
    ranking: str | None = None
    group: list = field(default_factory=list)
    having: tuple | None = None
    order: tuple | None = None  # (expression, descending)
    limit: tuple | None = None
    offset: tuple | None = None


class Parser:
    def __init__(self, text: str):
        self.toks, self.i = tokenize(text), 0

    # tokens
    def peek(self, k: int = 0) -> tuple[str, str]:
        return self.toks[self.i + k] if self.i + k < len(self.toks) else ("end", "")

    def at(self, *words: str) -> bool:
        return all(self.peek(k)[0] in ("id", "op") and self.peek(k)[1].lower() == w for k, w in enumerate(words))

    def take(self, *words: str) -> bool:
        if self.at(*words):
            self.i += len(words)
            return True
        return False

    def need(self, *words: str) -> None:
        if not self.take(*words):
            raise SqlError(f"expected {' '.join(words).upper()} near {self.peek()[1]!r}")

    def name(self) -> str:
        kind, v = self.peek()
        if kind != "id":
            raise SqlError(f"expected a name near {v!r}")
        self.i += 1
        return v

    def names(self) -> list[str]:
        self.need("(")
        out = [self.name()]
        while self.take(","):
            out.append(self.name())
        self.need(")")
        return out

    # statements
    def script(self) -> list[tuple]:
        out = []
        while self.peek()[0] != "end":
            if self.take(";"):
                continue
            out.append(self.statement())
            if self.peek()[0] != "end":
                self.need(";")
        return out

    def statement(self) -> tuple:
        if self.at("select"):
            return ("select", self.select())
        if self.take("insert", "into"):
            table = self.name()
            cols = self.names() if self.at("(") else None
            self.need("values")
            rows = [self.row()]
            while self.take(","):
                rows.append(self.row())
            return ("insert", table, cols, rows)
        if self.take("update"):
            table = self.name()
            self.need("set")
            sets = [self.assignment()]
            while self.take(","):
                sets.append(self.assignment())
            return ("update", table, sets, self.expr() if self.take("where") else None)
        if self.take("delete", "from"):
            table = self.name()
            return ("delete", table, self.expr() if self.take("where") else None)
        if self.take("truncate"):
            self.take("table")
            return ("truncate", self.name())
        if self.take("create"):
            return self.create()
        if self.take("drop"):
            what = "table" if self.take("table") else "index" if self.take("index") else None
            if not what:
                raise SqlError("expected TABLE or INDEX")
            exists = self.take("if", "exists")
            name = self.name()
            return ("drop_table", name, exists) if what == "table" else ("drop_index", name, self.name() if self.take("on") else None, exists)
        if self.take("begin"):
            self.take("transaction")
            return ("begin",)
        if self.take("commit") or self.take("end"):
            self.take("transaction")
            return ("commit",)
        if self.take("rollback"):
            if self.take("to"):
                self.take("savepoint")
                return ("rollback_to", self.name())
            return ("rollback",)
        if self.take("savepoint"):
            return ("savepoint", self.name())
        if self.take("release"):
            self.take("savepoint")
            return ("release", self.name())
        raise SqlError(f"statement not supported: {self.peek()[1]!r}")

    def row(self) -> list[tuple]:
        self.need("(")
        out = [self.expr()]
        while self.take(","):
            out.append(self.expr())
        self.need(")")
        return out

    def assignment(self) -> tuple[str, tuple]:
        col = self.name()
        self.need("=")
        return col, self.expr()

    def create(self) -> tuple:
        unique = self.take("unique")
        if self.take("index"):
            exists = self.take("if", "not", "exists")
            name = self.name()
            self.need("on")
            table = self.name()
            kind = self.name().lower() if self.take("using") else None
            cols = self.names()
            options = {}
            if self.take("with"):
                self.need("(")
                while not self.take(")"):
                    key = self.name().lower()
                    self.need("=")
                    options[key] = self.peek()[1]
                    self.i += 1
                    self.take(",")
            if len(cols) != 1:
                raise SqlError("an index has exactly one column")
            return ("create_index", name, table, kind, cols[0], options, unique, exists)
        clustered = self.take("clustered")
        self.need("table")
        name, cluster_by = self.name(), []
        if self.take("clustered"):
            clustered = True
            if self.take("by"):
                cluster_by = self.names()
        self.need("(")
        cols, keys, uniques, indexes = [], [], [], []
        while True:
            if self.take("constraint"):
                self.name()
            if self.take("primary", "key"):
                keys = self.names()
            elif self.at("unique", "("):
                self.i += 1
                uniques.append(self.names())
            elif self.at("index", "(") or self.at("key", "("):
                self.i += 1
                indexes += self.names()
            else:
                cols.append(self.column(keys, uniques, indexes))
            if not self.take(","):
                break
        self.need(")")
        return ("create_table", name, cols, keys or cluster_by, uniques, indexes, clustered)

    def column(self, keys: list, uniques: list, indexes: list) -> tuple:
        col, kind, size = self.name(), self.name().lower(), None
        if self.take("("):
            size = int(self.peek()[1])
            self.i += 1
            self.need(")")
        not_null = False
        while True:
            if self.take("primary", "key"):
                keys.append(col)
            elif self.take("unique"):
                uniques.append([col])
            elif self.take("not", "null"):
                not_null = True
            elif self.take("index") or self.take("key"):
                indexes.append(col)
            elif not self.take("null"):
                return col, kind, size, not_null

    def alias(self) -> str | None:
        if self.take("as"):
            return self.name()
        if self.peek()[0] == "id" and self.peek()[1].lower() not in RESERVED:
            return self.name()
        return None

    def select(self) -> Select:
        self.need("select")
        distinct = self.take("distinct")
        items = [self.item()]
        while self.take(","):
            items.append(self.item())
        if not self.take("from"):
            raise SqlError("SELECT without FROM")
        s = Select(items, self.name(), self.alias(), distinct=distinct)
        while kind := self.join_kind():
            table, alias = self.name(), self.alias()
            on, using = None, []
            if self.take("on"):
                on = self.expr()
            elif self.take("using"):
                using = self.names()
            elif kind != "cross":
                raise SqlError("JOIN needs ON or USING")
            s.joins.append((kind, table, alias, on, using))
        if self.take("where"):
            s.where = self.expr()
            if self.take("using"):
                s.ranking = self.name().lower()
        if self.take("group", "by"):
            s.group = [self.expr()]
            while self.take(","):
                s.group.append(self.expr())
        if self.take("having"):
            if not s.group:
                raise SqlError("HAVING without GROUP BY")
            s.having = self.expr()
        if self.take("order", "by"):
            e = self.expr()
            s.order = (e, self.take("desc"))
            self.take("asc")
        if self.take("limit"):
            s.limit = self.expr()
            if self.take("offset"):
                s.offset = self.expr()
        return s

    def join_kind(self) -> str | None:
        if self.take("join") or self.take("inner", "join"):
            return "inner"
        for kind in ("left", "right", "full"):
            if self.take(kind, "join") or self.take(kind, "outer", "join"):
                return kind
        return "cross" if self.take("cross", "join") else None

    def item(self) -> tuple:
        if self.take("*"):
            return ("star",), None
        e = self.expr()
        return e, self.name() if self.take("as") else None

    # expressions
    def expr(self) -> tuple:
        a = self.conj()
        while self.take("or") or self.take("||"):
            a = ("bin", "or", a, self.conj())
        return a

    def conj(self) -> tuple:
        a = self.comparison()
        while self.take("and") or self.take("&&"):
            a = ("bin", "and", a, self.comparison())
        return a

    def comparison(self) -> tuple:
        a = self.sum()
        for op in ("<=", ">=", "!=", "<>", "==", "=", "<", ">"):
            if self.peek() == ("op", op):
                self.i += 1
                return ("bin", {"==": "=", "<>": "!="}.get(op, op), a, self.sum())
        return a

    def sum(self) -> tuple:
        a = self.product()
        while self.peek() in (("op", "+"), ("op", "-")):
            op = self.peek()[1]
            self.i += 1
            a = ("bin", op, a, self.product())
        return a

    def product(self) -> tuple:
        a = self.unary()
        while self.peek() in (("op", "*"), ("op", "/")):
            op = self.peek()[1]
            self.i += 1
            a = ("bin", op, a, self.unary())
        return a

    def unary(self) -> tuple:
        if self.take("-"):
            return ("neg", self.unary())
        if self.take("+"):
            return self.unary()
        kind, v = self.peek()
        if self.take("("):
            e = self.expr()
            self.need(")")
            return e
        self.i += 1
        if kind == "num":
            return ("lit", float(v), "float") if "." in v else ("lit", int(v), "int")
        if kind == "str":
            return ("lit", v, "text")
        if kind == "id":
            if v.lower() in ("true", "false") and not self.at("("):
                return ("lit", v.lower() == "true", "bool")
            if v.lower() == "null":
                return ("lit", None, "null")
            if self.take("("):
                args = []
                if self.take("*"):
                    args = [("star",)]
                elif not self.at(")"):
                    args = [self.expr()]
                    while self.take(","):
                        args.append(self.expr())
                self.need(")")
                return ("call", v.lower(), args)
            if v.lower() in RESERVED:
                raise SqlError(f"unexpected {v!r}")
            return ("col", v, self.name()) if self.take(".") else ("col", None, v)
        raise SqlError(f"unexpected {v or 'end of statement'!r}")


def parse(text: str) -> list[tuple]:
    return Parser(text).script()
