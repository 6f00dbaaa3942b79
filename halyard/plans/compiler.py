"""From parsed statements to Spark SQL text. Every construct becomes a built-in expression; Catalyst does the rest."""

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from halyard.functions import scalar, spatial, vector
from halyard.operators import text_search
from halyard.plans.catalog import Table
from halyard.plans.parser import Select, SqlError

AGGREGATES = {"count", "sum", "avg", "min", "max"}
DISTANCE = {"distancia", "distance", "st_distance"}
WITHIN = {"dentro", "within", "st_within", "st_contains", "st_intersects"}
VECTOR_DISTANCE = {"vector_distance", "distancia_vector", "vector_dist", "knn_distance"}
MATCH = {"match", "matches", "match_against"}


@dataclass
class Scope:
    tables: list[tuple[str, Table, DataFrame]]  # (alias, definition, rows)
    grouped: set = field(default_factory=set)
    aggregating: bool = False
    default_metric: tuple[str, str] | None = None  # (column, metric) of the index that serves ORDER BY; given to that only

    def first(self, text: str) -> str:
        """A column outside GROUP BY: of the group's first row in key order, so that the answer does not change with the plan."""
        keys = [f"`{a}`.`{k}`" for a, t, _ in self.tables for k in t.key]
        return f"min_by({text}, struct({', '.join(keys)}))"

    def resolve(self, qualifier: str | None, name: str) -> tuple[str, str]:
        hits = [(a, c) for a, t, _ in self.tables if qualifier is None or qualifier.lower() in (a.lower(), t.name.lower() if len(self.tables) == 1 else a.lower()) for c in t.columns if c.name.lower() == name.lower()]
        if not hits:
            raise SqlError(f"no column {name!r}")
        if len(hits) > 1:
            raise SqlError(f"column {name!r} is ambiguous")
        a, c = hits[0]
        return f"`{a}`.`{c.name}`", {"long": "int"}.get(c.kind, c.kind)


def constant_point(e: tuple) -> tuple[float, float] | None:
    if e[0] == "call" and e[1] == "point" and len(e[2]) == 2:
        xs = [constant(a) for a in e[2]]
        return None if None in xs else (float(xs[0]), float(xs[1]))
    return None


def constant(e: tuple):
    if e[0] == "lit" and e[2] in ("int", "float"):
        return e[1]
    if e[0] == "neg":
        v = constant(e[1])
        return None if v is None else -v
    return None


def is_constant(e) -> bool:
    """Whether an expression names no column."""
    return e[0] == "lit" or e[0] in ("neg", "bin", "call") and all(is_constant(x) for p in e[1:] for x in (p if isinstance(p, list) else [p]) if isinstance(x, tuple))


def metric_of(e: tuple) -> str:
    return str(e[1]) if e[0] == "lit" else e[2] if e[0] == "col" else ""


def has_aggregate(e) -> bool:
    return isinstance(e, tuple) and (e[:1] == ("call",) and e[1] in AGGREGATES or any(has_aggregate(x) for x in e)) or isinstance(e, list) and any(map(has_aggregate, e))


def sql(e: tuple, s: Scope) -> tuple[str, str]:
    """(Spark SQL text, kind)."""
    if s.aggregating and repr(e) in s.grouped:
        return sql(e, Scope(s.tables, default_metric=s.default_metric))
    tag = e[0]
    if tag == "lit":
        v, kind = e[1], e[2]
        if v is None:
            return "NULL", "null"
        if kind == "text":
            return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'", "text"
        return {"bool": str(v).lower(), "int": f"{v}L", "float": f"{v!r}D"}[kind], kind
    if tag == "col":
        text, kind = s.resolve(e[1], e[2])
        return (s.first(text), kind) if s.aggregating else (text, kind)
    if tag == "neg":
        a, kind = sql(e[1], s)
        return f"(- {a})", kind
    if tag == "bin":
        return binary(e, s)
    if tag == "call":
        return call(e[1], e[2], s)
    raise SqlError("* is not an expression")


def condition(e: tuple, s: Scope) -> str:
    text, kind = sql(e, s)
    return text if kind == "bool" else scalar.truthy(text, kind) if kind != "null" else "false"


def binary(e: tuple, s: Scope) -> tuple[str, str]:
    _, op, x, y = e
    if op in ("and", "or"):
        return f"({condition(x, s)} {op.upper()} {condition(y, s)})", "bool"
    if op in ("<", "<=", "=") and x[0] == "call":
        if op != "=" and x[1] in DISTANCE and (r := constant(y)) is not None and not s.aggregating:
            if (box := distance_box(x[2], float(r), s)) is not None:
                return f"({box} AND {call(x[1], x[2], s)[0]} {op} {float(r)!r}D)", "bool"
    (a, ka), (b, kb) = sql(x, s), sql(y, s)
    if op in ("+", "-", "*"):
        return f"({a} {op} {b})", "int" if (ka, kb) == ("int", "int") else "float"
    if op == "/":
        ints = (ka, kb) == ("int", "int")
        return scalar.safe_div(a, b, ints), "int" if ints else "float"
    if ka == "point" and kb == "text":
        b = spatial.point_from_text(b)
    if ka == "vector" and kb == "text":
        b = vector.from_text(b)
    return f"({a} {op} {b})", "bool"


def distance_box(args: list, r: float, s: Scope) -> str | None:
    if len(args) < 2 or args[0][0] != "col" or (c := constant_point(args[1])) is None:
        return None
    col, kind = s.resolve(args[0][1], args[0][2])
    if kind != "point":
        return None
    euclid = len(args) > 2 and metric_of(args[2]).lower() in spatial.EUCLIDEAN
    return (spatial.degree_box if euclid else spatial.radius_box)(f"{col}.lat", f"{col}.lon", c, r)


def as_point(e: tuple, s: Scope) -> str:
    text, kind = sql(e, s)
    return spatial.point_from_text(text) if kind == "text" else text


def as_vector(e: tuple, s: Scope) -> str:
    text, kind = sql(e, s)
    return vector.from_text(text) if kind == "text" else text


def call(name: str, args: list, s: Scope) -> tuple[str, str]:
    if name in AGGREGATES:
        if not s.aggregating:
            raise SqlError(f"{name.upper()} needs GROUP BY or a select list of aggregates")
        if len(args) != 1:
            raise SqlError(f"{name.upper()} takes one argument")
        if args == [("star",)]:
            return "count(1)", "int"
        a, kind = sql(args[0], Scope(s.tables, default_metric=s.default_metric))
        return f"{name}({a})", {"count": "int", "avg": "float", "sum": kind}.get(name, kind)
    if name == "point":
        if len(args) == 1:
            return as_point(args[0], s), "point"
        (a, _), (b, _) = (sql(x, s) for x in args)
        return spatial.point(a, b), "point"
    if name == "polygon":
        if len(args) < 3:
            raise SqlError("POLYGON needs at least 3 points")
        return f"array({', '.join(as_point(a, s) for a in args)})", "polygon"
    if name in DISTANCE:
        return spatial.distance(as_point(args[0], s), as_point(args[1], s), metric_of(args[2]) if len(args) > 2 else "haversine"), "float"
    if name in WITHIN:
        p, ring = as_point(args[0], s), args[1]
        if ring[0] == "call" and ring[1] == "polygon" and all(points := [constant_point(a) for a in ring[2]]):
            return f"coalesce({spatial.polygon_box(f'({p}).lat', f'({p}).lon', points)} AND {spatial.within_ring(f'({p}).lat', f'({p}).lon', points)}, false)", "bool"
        return spatial.within_array(f"({p}).lat", f"({p}).lon", sql(ring, s)[0]), "bool"
    if name in ("lat", "latitud", "lon", "longitud"):
        return f"({as_point(args[0], s)}).{name[:3]}", "float"
    if name in ("vector", "vector_literal"):
        if len(args) == 1 and sql(args[0], s)[1] == "text":
            return as_vector(args[0], s), "vector"
        return vector.literal([sql(a, s)[0] for a in args]), "vector"
    if name in VECTOR_DISTANCE:
        own = (args[0][2].lower(), s.default_metric[1]) if s.default_metric and args[0][0] == "col" else None
        metric = metric_of(args[2]) if len(args) > 2 else own[1] if own and own[0] == s.default_metric[0] else "euclidean"
        return vector.distance(as_vector(args[0], s), as_vector(args[1], s), metric), "float"
    if name in MATCH:
        if len(args) < 2 or args[0][0] != "col" or args[1][0] != "lit":
            raise SqlError("MATCH takes a column and a text")
        col, _ = s.resolve(args[0][1], args[0][2])
        alias = col.split("`")[1]
        df = next(d for a, _, d in s.tables if a == alias)
        return text_search.match_score(df.alias(alias), col, args[1][1], metric_of(args[2]) if len(args) > 2 else "tf-idf"), "float"
    raise SqlError(f"function not implemented: {name}")


def label(e: tuple) -> str:
    return e[2] if e[0] == "col" else e[1] if e[0] == "call" else str(e[1]) if e[0] == "lit" else "expr"


def knn_metric(q: Select, table: Table) -> str | None:
    """Metric of the vector index that serves ORDER BY vector_distance(col, q) LIMIT k; a conflicting metric is an error."""
    if q.order and q.limit is not None and not q.order[1] and q.order[0][0] == "call" and q.order[0][1] in VECTOR_DISTANCE and q.order[0][2][0][0] == "col":
        args = q.order[0][2]
        for ix in table.indexes:
            if ix.column.lower() == args[0][2].lower() and ix.kind in ("ivf", "hnsw", "image", "audio"):
                own = vector.metric_name(str(ix.options.get("metric", "euclidean")))
                if len(args) > 2 and vector.metric_name(metric_of(args[2])) != own:
                    raise SqlError(f"index {ix.name!r} uses the metric {own!r}")
                return own
    return None


def whole_number(e: tuple | None, what: str) -> int | None:
    if e is None:
        return None
    v = fold(e)
    if not isinstance(v, int) or isinstance(v, bool) or v < 0:
        raise SqlError(f"{what} must be a whole number, not negative")
    return v


def fold(e: tuple):
    if e[0] == "lit":
        return e[1]
    if e[0] == "neg":
        return -fold(e[1])
    if e[0] == "bin" and e[1] in "+-*/":
        a, b = fold(e[2]), fold(e[3])
        return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: (a // b if b else 0)}[e[1]]()
    raise SqlError("a constant is needed")


def select(q: Select, lookup) -> str:
    """Spark SQL of a query block. lookup(table) gives (definition, view, rows)."""
    t, view, df = lookup(q.table)
    alias = q.alias or q.table
    s, served = Scope([(alias, t, df)]), knn_metric(q, t)
    source = f"{view} AS `{alias}`"
    for kind, table, as_, on, using in q.joins:
        rt, rview, rdf = lookup(table)
        name = as_ or table
        if any(name.lower() == a.lower() for a, _, _ in s.tables):
            raise SqlError(f"alias {name!r} is used twice")
        left = Scope(list(s.tables))
        s.tables.append((name, rt, rdf))
        source += f" {kind.upper()} JOIN {rview} AS `{name}`"
        if using:
            pairs = []
            for c in using:
                owner = next((a for a, lt, _ in left.tables if any(x.name.lower() == c.lower() for x in lt.columns)), None)
                if owner is None:
                    raise SqlError(f"no column {c!r} to join by")
                pairs.append(f"`{owner}`.`{c}` = `{name}`.`{rt.column(c).name}`")
            source += " ON " + " AND ".join(pairs)
        elif on is not None:
            source += f" ON {condition(on, s)}" if kind != "cross" else ""
            if kind == "cross":
                source = source.replace(f" CROSS JOIN {rview} AS `{name}`", f" INNER JOIN {rview} AS `{name}` ON {condition(on, s)}")
    aliases = {a.lower(): e for e, a in q.items if a}
    order = q.order
    if order and order[0][0] == "col" and order[0][1] is None and order[0][2].lower() in aliases:
        order = (aliases[order[0][2].lower()], order[1])
    plain = Scope(s.tables, default_metric=s.default_metric)
    groups = [sql(g, plain)[0] for g in q.group]
    agg = bool(q.group) or has_aggregate([e for e, _ in q.items]) or bool(order and has_aggregate(order[0]))
    if agg:
        s.aggregating, s.grouped = True, {repr(g) for g in q.group}
    items, names = [], []
    for e, a in q.items:
        if e == ("star",):
            for al, tab, _ in s.tables:
                for c in tab.columns:
                    text = f"`{al}`.`{c.name}`"
                    items.append(s.first(text) if agg and repr(("col", None, c.name)) not in s.grouped else text)
                    names.append(f"{al}.{c.name}" if len(s.tables) > 1 else c.name)
            break
        items.append(sql(e, s)[0])
        names.append(a or label(e))
    while len(set(names)) < len(names):  # the same label twice
        names = [n if n not in names[:i] else f"{n}_{i}" for i, n in enumerate(names)]
    out = "SELECT " + ("DISTINCT " if q.distinct else "") + ", ".join(f"{x} AS `{n}`" for x, n in zip(items, names, strict=True))
    out += f" FROM {source}"
    if q.where is not None:
        out += f" WHERE {condition(q.where, plain)}"
    if groups:
        out += " GROUP BY " + ", ".join(groups)
    if q.having is not None:
        out += f" HAVING {condition(q.having, s)}"
    if order:
        near = Scope(s.tables, s.grouped, s.aggregating, (q.order[0][2][0][2].lower(), served)) if served else s
        text = sql(order[0], near)[0]
        if q.distinct and text in items:
            text = f"`{names[items.index(text)]}`"
        out += f" ORDER BY {text} {'DESC NULLS LAST' if order[1] else 'ASC NULLS FIRST'}"
        if not agg and not q.distinct:
            out += "".join(f", `{alias}`.`{k}`" for k in t.key)
    limit, offset = whole_number(q.limit, "LIMIT"), whole_number(q.offset, "OFFSET")
    out += "" if limit is None else f" LIMIT {limit}"
    return out + ("" if offset is None else f" OFFSET {offset}")
