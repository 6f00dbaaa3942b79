"""Sessions: SQL statements, scripts, transactions and savepoints over snapshots of Parquet folders.

A statement outside a transaction commits by itself and as a whole. Inside one, changes are staged in the session and become
visible to others at COMMIT; if another session changed a table that this one read or wrote, COMMIT raises Conflict, after which
the client runs its transaction again.
"""

import copy
import hashlib
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from halyard.functions import scalar, spatial, vector
from halyard.operators import text_search, vector_search
from halyard.plans import compiler
from halyard.plans.catalog import Column, Index, Store, Table, make_column
from halyard.plans.parser import Select, SqlError, parse
from halyard.sources.readers import read_csv


class Conflict(RuntimeError):
    """Another session committed first; run the transaction again."""


class Duplicate(SqlError):
    pass


@dataclass
class Result:
    df: DataFrame | None = None
    affected: int = 0
    message: str = ""
    elapsed_ms: float = 0.0

    @property
    def columns(self) -> list[str]:
        return self.df.columns if self.df is not None else []

    def rows(self) -> list[tuple]:
        """Collected rows for display, points as text."""
        if self.df is None:
            return []
        cols = [F.expr(spatial.point_to_text(f"`{n}`")).alias(n) if k.startswith("struct<lat:") else F.col(f"`{n}`") for n, k in self.df.dtypes]
        return [tuple(r) for r in self.df.select(*cols).collect()]

    def plan(self) -> str:
        return self.df._jdf.queryExecution().toString() if self.df is not None else ""


@dataclass
class _Transaction:
    tables: dict[str, Table]
    base: int
    id: str = field(default_factory=lambda: uuid.uuid4().hex[:8])
    touched: set = field(default_factory=set)
    changes: int = 0
    savepoints: list = field(default_factory=list)


class Engine:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.store = spark, Store(spark, path)

    def session(self) -> "Session":
        return Session(self)


class Session:
    def __init__(self, engine: Engine):
        self.engine, self.spark, self.store = engine, engine.spark, engine.store
        self.tx: _Transaction | None = None

    # public
    def sql(self, text: str) -> Result:
        out = self.script(text)
        if len(out) != 1:
            raise SqlError("one statement expected")
        return out[0]

    def script(self, text: str) -> list[Result]:
        """The whole text is parsed before anything runs; it stops at the first failing statement."""
        out = []
        for st in parse(text):
            began = time.time()
            out.append(self._run(st))
            out[-1].elapsed_ms = (time.time() - began) * 1000
        return out

    def in_transaction(self) -> bool:
        return self.tx is not None

    def table_names(self) -> list[str]:
        return sorted(t.name for t in self._tables().values())

    def describe(self, table: str) -> Table:
        return self._table(table)

    def table(self, name: str) -> DataFrame:
        return self.store.frame(self._table(name))

    def close(self) -> None:
        self.tx = None

    @staticmethod
    def touches(text: str) -> set[str]:
        """Tables that a script would change."""
        return {st[1].lower() for st in parse(text) if st[0] in ("insert", "update", "delete", "truncate", "drop_table", "create_table")}

    def insert_frame(self, table: str, df: DataFrame) -> Result:
        """Bulk insert of columns by name, with the same checks as INSERT."""
        return self._write(lambda tables: self._insert(tables, table, df))

    def import_csv(self, table: str, path: str) -> tuple[Result, DataFrame]:
        """(result, rejected rows) of a CSV file, columns by position."""
        t = self._table(table)
        good, bad = read_csv(self.spark, path, [(c.name, {"long": "bigint"}.get(c.kind, c.kind)) for c in t.columns])
        return self.insert_frame(table, good), bad

    # snapshots
    def _tables(self) -> dict[str, Table]:
        return self.tx.tables if self.tx else self.store.read(self.store.latest())

    def _table(self, name: str, tables: dict | None = None) -> Table:
        t = (self._tables() if tables is None else tables).get(name.lower())
        if t is None:
            raise SqlError(f"no table {name!r}")
        return t

    def _write(self, change) -> Result:
        """change(tables) edits a snapshot in place and returns (result, table names)."""
        if self.tx:
            draft = copy.deepcopy(self.tx.tables)
            result, names = change(draft)
            self.tx.tables = draft
            self.tx.touched |= names
            self.tx.changes += result.affected
            return result
        n = self.store.latest()
        draft = self.store.read(n)
        result, names = change(draft)
        self._commit(n, draft, names)
        return result

    def _commit(self, base: int, draft: dict[str, Table], names: set) -> None:
        while not self.store.commit(base, draft):
            before, base = self.store.read(base), self.store.latest()
            now = self.store.read(base)
            if any(before.get(n) != now.get(n) for n in names):
                raise Conflict("another session changed the same table")
            draft = now | {n: draft[n] for n in names if n in draft}
            draft = {k: v for k, v in draft.items() if k in now or k in names}

    # statements
    def _run(self, st: tuple) -> Result:
        kind = st[0]
        if kind == "select":
            return Result(self._select(st[1]))
        if kind in ("create_table", "drop_table", "create_index", "drop_index") and self.tx:
            raise SqlError("definitions cannot change inside a transaction")
        if kind == "insert":
            return self._write(lambda tables: self._insert(tables, st[1], self._values(self._table(st[1], tables), st[2], st[3])))
        if kind == "update":
            return self._write(lambda tables: self._update(tables, st[1], st[2], st[3]))
        if kind == "delete":
            return self._write(lambda tables: self._delete(tables, st[1], st[2]))
        if kind == "truncate":
            return self._write(lambda tables: self._delete(tables, st[1], None))
        if kind == "create_table":
            return self._write(lambda tables: self._create_table(tables, *st[1:]))
        if kind == "create_index":
            return self._write(lambda tables: self._create_index(tables, *st[1:]))
        if kind == "drop_index":
            return self._write(lambda tables: self._drop_index(tables, *st[1:]))
        if kind == "drop_table":
            return self._drop_table(st[1], st[2])
        return {"begin": self._begin, "commit": self._commit_tx, "rollback": self._rollback, "rollback_to": self._rollback_to, "savepoint": self._savepoint, "release": self._release}[kind](*st[1:])

    def _begin(self) -> Result:
        if self.tx:
            raise SqlError("a transaction is open")
        n = self.store.latest()
        self.tx = _Transaction(self.store.read(n), n)
        return Result(message=f"transaction {self.tx.id}")

    def _open(self) -> _Transaction:
        if not self.tx:
            raise SqlError("no transaction is open")
        return self.tx

    def _commit_tx(self) -> Result:
        tx = self._open()
        self.tx = None
        latest = self.store.latest()
        if latest != tx.base:
            before, now = self.store.read(tx.base), self.store.read(latest)
            if any(before.get(n) != now.get(n) for n in tx.touched):
                raise Conflict("another session changed the same table")
        written = {n for n in tx.touched if tx.tables.get(n) != self.store.read(tx.base).get(n)}
        if written:
            self._commit(tx.base, tx.tables, tx.touched)
        return Result(affected=tx.changes, message="committed")

    def _rollback(self) -> Result:
        self._open()
        self.tx = None
        return Result(message="rolled back")

    def _savepoint(self, name: str) -> Result:
        tx = self._open()
        tx.savepoints = [s for s in tx.savepoints if s[0] != name.lower()] + [(name.lower(), copy.deepcopy(tx.tables), tx.changes)]
        return Result(message=f"savepoint {name}")

    def _find(self, name: str) -> int:
        for i, s in enumerate(self._open().savepoints):
            if s[0] == name.lower():
                return i
        raise SqlError(f"no savepoint {name!r}")

    def _rollback_to(self, name: str) -> Result:
        i, tx = self._find(name), self.tx
        tx.tables, tx.changes, tx.savepoints = copy.deepcopy(tx.savepoints[i][1]), tx.savepoints[i][2], tx.savepoints[: i + 1]
        return Result(message=f"rolled back to {name}")

    def _release(self, name: str) -> Result:
        i = self._find(name)
        self.tx.savepoints = self.tx.savepoints[:i]
        return Result(message=f"released {name}")

    # definitions
    def _create_table(self, tables, name, cols, key, uniques, indexes, clustered):
        if name.lower() in tables:
            raise SqlError(f"table {name!r} exists")
        columns = [make_column(*c) for c in cols]
        if len({c.name.lower() for c in columns}) != len(columns):
            raise SqlError("a column name is used twice")
        t = Table(name, columns, [], clustered=clustered)
        if not key:
            raise SqlError("a table needs a PRIMARY KEY")
        t.key = [t.column(k).name for k in key]
        if any(t.column(k).kind == "vector" for k in key):
            raise SqlError("a vector cannot be a key")
        t.uniques = [[t.column(c).name for c in u] for u in uniques]
        t.indexes = [Index(f"{name}_{t.column(c).name}", "vector" if t.column(c).kind == "vector" else "btree", t.column(c).name) for c in indexes]
        t.indexes += [Index(f"{name}_{c.name}_rtree", "rtree", c.name) for c in columns if c.kind == "point"]
        tables[name.lower()] = t
        return Result(message=f"table {name} created"), {name.lower()}

    def _drop_table(self, name: str, exists: bool) -> Result:
        if exists and name.lower() not in self._tables():
            return Result(message="nothing to drop")

        def change(tables):
            self._table(name, tables)
            del tables[name.lower()]
            return Result(message=f"table {name} dropped"), {name.lower()}

        return self._write(change)  # its folders stay for readers of older snapshots, until vacuum

    def _create_index(self, tables, name, table, kind, column, options, unique, exists):
        t = self._table(table, tables)
        if any(i.name.lower() == name.lower() for i in t.indexes):
            if exists:
                return Result(message="index exists"), set()
            raise SqlError(f"index {name!r} exists")
        c = t.column(column)
        if kind is None:
            low = name.lower()
            kind = "ivf" if c.kind == "vector" else "rtree" if low.startswith("rtree") or c.kind == "point" else "hash" if low.startswith("hash") else "btree"
        if kind in ("ivf", "hnsw") and c.kind != "vector":
            raise SqlError(f"{kind.upper()} needs a vector column")
        if "metric" in options and vector.metric_name(options["metric"]) == "dot" and kind == "ivf":
            raise SqlError("IVF does not take the dot product")
        if unique:
            self._check_unique(self.store.frame(t), [[c.name]])
        ix = Index(name, kind, c.name, options, unique)
        t.indexes.append(ix)
        if unique:
            t.uniques.append([c.name])
        if kind == "ivf":
            self._fit_lists(t, ix)
        elif kind in ("btree", "hash") and t.folders and not t.clustered:
            t.folders = [self.store.write(t, self.store.frame(t))]  # laid out by the index
            self._keep_lists(t)
        return Result(message=f"index {name} created"), {table.lower()}

    def _fit_lists(self, t: Table, ix: Index) -> None:
        """Cells of an IVF index, once the table has as many rows as lists; until then a search reads all rows."""
        df = self.store.frame(t).filter(F.col(f"`{ix.column}`").isNotNull())
        n = df.count()
        asked = ix.options.get("nlist")
        if n < max(2, int(asked or 2)) or len(t.key) != 1:
            return
        ivf = vector_search.IVF(df, int(asked) if asked else None, str(ix.options.get("metric", "euclidean")), ix.column, t.key[0])
        ix.centroids, ix.parts = ivf.centroids, {}
        self._keep_lists(t)

    def _keep_lists(self, t: Table) -> None:
        """Rows by list for every folder of the table that an IVF index does not have yet."""
        for ix in t.indexes:
            if ix.kind != "ivf":
                continue
            if not ix.centroids:
                if t.folders and self.store.frame(t).limit(int(ix.options.get("nlist") or 2)).count() >= int(ix.options.get("nlist") or 2):
                    self._fit_lists(t, ix)
                continue
            ivf = vector_search.IVF.with_centroids(ix.centroids, str(ix.options.get("metric", "euclidean")), ix.column, t.key[0])
            ix.parts = {f: p for f, p in ix.parts.items() if f in t.folders}
            for folder in t.folders:
                if folder not in ix.parts:
                    part = f"{self.store.path}/{t.name}/{uuid.uuid4().hex}"
                    rows = self.spark.read.schema(t.schema).parquet(folder)
                    ivf.assigned(rows).repartition("list_id").write.partitionBy("list_id").parquet(part)
                    ix.parts[folder] = part

    def _probed(self, q: Select, t: Table) -> DataFrame | None:
        """Only the nearest lists' rows, for ORDER BY vector_distance(column, constant) LIMIT k without WHERE on an IVF index."""
        if q.joins or q.where is not None or q.group or q.having is not None or q.distinct or compiler.knn_metric(q, t) is None:
            return None
        args = q.order[0][2]
        ix = next((i for i in t.indexes if i.kind == "ivf" and i.column.lower() == args[0][2].lower()), None)
        limit = compiler.whole_number(q.limit, "LIMIT") + (compiler.whole_number(q.offset, "OFFSET") or 0)
        if ix is None or not ix.centroids or set(ix.parts) != set(t.folders) or not compiler.is_constant(args[1]):
            return None
        query = self.spark.sql(f"SELECT {compiler.as_vector(args[1], compiler.Scope([]))} AS v").first().v
        if query is None:
            return None
        ivf = vector_search.IVF.with_centroids(ix.centroids, str(ix.options.get("metric", "euclidean")), ix.column, t.key[0])
        wanted = max(1, int(ix.options.get("nprobe") or round(ivf.nlist / 4)))
        names = [F.col(f"`{c.name}`") for c in t.columns]
        every = [self.spark.read.schema(t.schema.add("list_id", IntegerType())).parquet(p) for p in ix.parts.values()]
        while True:  # short lists may hold fewer rows than asked for
            lists = [-1, *ivf.probes(query, wanted)]
            some = [e.filter(F.col("list_id").isin(lists)).select(*names) for e in every]
            out = some[0]
            for s in some[1:]:
                out = out.unionByName(s)
            if wanted >= ivf.nlist or out.limit(limit).count() >= limit:
                return out
            wanted *= 2

    def _drop_index(self, tables, name, table, exists):
        owners = [t for t in tables.values() if (table is None or t.name.lower() == table.lower()) and any(i.name.lower() == name.lower() for i in t.indexes)]
        if not owners:
            if exists:
                return Result(message="nothing to drop"), set()
            raise SqlError(f"no index {name!r}")
        if len(owners) > 1:
            raise SqlError(f"index {name!r} is on several tables; name one")
        t = owners[0]
        gone = next(i for i in t.indexes if i.name.lower() == name.lower())
        t.indexes.remove(gone)
        if gone.unique:
            t.uniques.remove([gone.column])
        return Result(message=f"index {name} dropped"), {t.name.lower()}

    # rows
    def _values(self, t: Table, cols: list[str] | None, rows: list[list]) -> DataFrame:
        names = [t.column(c).name for c in cols] if cols else [c.name for c in t.columns]
        out, scope = [], compiler.Scope([])
        for row in rows:
            if len(row) != len(names):
                raise SqlError(f"{len(names)} values expected, {len(row)} given")
            by = dict(zip(names, row, strict=True))
            out.append("struct(" + ", ".join(f"{self._coerced(c, by.get(c.name, ('lit', None, 'null')), scope)} AS `{c.name}`" for c in t.columns) + ")")
        return self.spark.sql(f"SELECT inline(array({', '.join(out)}))")  # one relation, however many rows

    def _coerced(self, c: Column, e: tuple, scope) -> str:
        text, kind = compiler.sql(e, scope)
        if kind == "null":
            return f"CAST(NULL AS {c.spark.simpleString()})"
        if c.kind == "point" and kind == "text":
            text = spatial.point_from_text(text)
            return f"coalesce({text}, raise_error('not a point'))"
        if c.kind == "vector" and kind == "text":
            return f"coalesce({vector.from_text(text)}, raise_error('not a vector'))"
        if c.kind == "bool" and kind != "bool":
            return scalar.truthy(text, kind)
        return f"CAST({text} AS {c.spark.simpleString()})"

    def _checked(self, t: Table, df: DataFrame) -> DataFrame:
        """A row that breaks a length, dimension or null rule raises an error while it is written."""
        for c in t.columns:
            x = f"`{c.name}`"
            if c.kind in ("text", "bytes") and c.size:
                df = df.withColumn(c.name, F.expr(f"CASE WHEN octet_length({x}) > {c.size} THEN raise_error('{c.name}: longer than {c.size} bytes') ELSE {x} END"))
            if c.kind == "vector":
                df = df.withColumn(c.name, F.expr(f"CASE WHEN size({x}) <> {c.size} THEN raise_error('{c.name}: {c.size} components expected') ELSE {x} END"))
            if c.not_null or c.name in t.key:
                df = df.withColumn(c.name, F.expr(f"coalesce({x}, raise_error('{c.name}: null not allowed'))"))
        return df

    def _check_unique(self, df: DataFrame, groups: list[list[str]]) -> None:
        for cols in groups:
            if df.dropna(subset=cols).groupBy(*cols).agg(F.count("*").alias("n")).filter("n > 1").limit(1).count():
                raise Duplicate(f"duplicate value in ({', '.join(cols)})")

    def _insert(self, tables, name: str, df: DataFrame):
        t = self._table(name, tables)
        given = {c.lower(): c for c in df.columns}
        df = df.select(*[F.col(f"`{given[c.name.lower()]}`").cast(c.spark).alias(c.name) if c.name.lower() in given else F.lit(None).cast(c.spark).alias(c.name) for c in t.columns])
        folder = self.store.write(t, self._checked(t, df))  # staged; nothing sees it before the manifest names it
        fresh = self.spark.read.schema(t.schema).parquet(folder)
        self._check_unique(fresh, [t.key, *t.uniques])
        if t.folders:
            for cols in [t.key, *t.uniques]:
                if fresh.join(self.store.frame(t).select(*cols), cols, "left_semi").limit(1).count():
                    raise Duplicate(f"duplicate value in ({', '.join(cols)})")
        t.folders.append(folder)
        self._keep_lists(t)
        return Result(affected=fresh.count()), {name.lower()}

    def _scope(self, t: Table) -> tuple[compiler.Scope, DataFrame]:
        df = self.store.frame(t)
        return compiler.Scope([(t.name, t, df)]), df.alias(t.name)

    def _update(self, tables, name: str, sets: list, where):
        t = self._table(name, tables)
        scope, df = self._scope(t)
        cond = F.expr(compiler.condition(where, scope)) if where is not None else F.lit(True)
        df = df.withColumn("__hit", F.coalesce(cond, F.lit(False)))
        affected = df.filter("__hit").count()
        if not affected:
            return Result(), {name.lower()}
        for col, e in sets:  # left to right: later assignments see earlier ones
            c = t.column(col)
            df = df.alias(t.name).withColumn(c.name, F.when(F.col("__hit"), F.expr(self._coerced(c, e, scope))).otherwise(F.col(f"`{c.name}`")))
        folder = self.store.write(t, self._checked(t, df.drop("__hit")))
        changed = {t.column(c).name for c, _ in sets}
        self._check_unique(self.spark.read.schema(t.schema).parquet(folder), [g for g in [t.key, *t.uniques] if changed & set(g)])
        t.folders = [folder]
        self._keep_lists(t)
        return Result(affected=affected), {name.lower()}

    def _delete(self, tables, name: str, where):
        t = self._table(name, tables)
        scope, df = self._scope(t)
        if where is None:
            n = df.count()
            t.folders = []
            return Result(affected=n), {name.lower()}
        cond = F.coalesce(F.expr(compiler.condition(where, scope)), F.lit(False))
        n = df.filter(cond).count()
        if n:
            t.folders = [self.store.write(t, df.filter(~cond))]
            self._keep_lists(t)
        return Result(affected=n), {name.lower()}

    # queries
    def _lookup(self, name: str) -> tuple[Table, str, DataFrame]:
        t = self._table(name)
        if self.tx:
            self.tx.touched.add(name.lower())
        df = self.store.frame(t)
        view = f"hy_{t.name}_{uuid.uuid4().hex[:12]}"
        df.createOrReplaceTempView(view)
        return t, view, df

    def _select(self, q: Select) -> DataFrame:
        if q.ranking:
            return self._ranked(q)
        views = []

        def lookup(name):
            t, view, df = self._lookup(name)
            near = self._probed(q, t)
            if near is not None:
                df = near
                df.createOrReplaceTempView(view)
            views.append(view)
            return t, view, df

        try:
            return self.spark.sql(compiler.select(q, lookup))  # analysed here, so the views can go
        finally:
            for v in views:
                self.spark.catalog.dropTempView(v)

    def _ranked(self, q: Select) -> DataFrame:
        w = q.where
        if q.joins or q.group or compiler.has_aggregate([e for e, _ in q.items]) or w[0] != "call" or w[1] not in compiler.MATCH:
            raise SqlError("ranked search takes one table and MATCH alone in WHERE")
        t, view, df = self._lookup(q.table)
        self.spark.catalog.dropTempView(view)
        if len(t.key) != 1:
            raise SqlError("ranked search needs a key of one column")
        key, col = t.key[0], t.column(w[2][0][2]).name
        # kept for this state of the table: built at the first search after a change
        state = hashlib.sha256(repr((t.folders, col, key)).encode()).hexdigest()[:32]
        ix = text_search.index(df, col, key, path=f"{self.store.path}/_text/{state}")
        words = text_search.analyse_query(w[2][1][1])
        method = {"bm25": ix.bm25, "tf_idf": ix.cosine, "tfidf": ix.cosine}.get(q.ranking)
        if not method:
            raise SqlError(f"unknown ranking {q.ranking!r}")
        hits = method(words, None).withColumnsRenamed({"doc": key, "score": "__score"})
        out, cols = df.join(hits, key), []
        for e, a in q.items:
            if e == ("star",):
                cols += [F.col(f"`{c.name}`") for c in t.columns]
            elif e == ("call", "score", []):
                cols.append(F.col("__score").alias(a or "score"))
            elif e[0] == "col":
                cols.append(F.col(f"`{t.column(e[2]).name}`").alias(a or e[2]))
            else:
                raise SqlError("ranked search projects columns and SCORE() only")
        order, down = q.order or (("call", "score", []), True)
        by = F.col("__score") if order[0] == "call" else F.col(f"`{t.column(order[2]).name}`")
        out = out.orderBy(by.desc() if down else by.asc(), key)
        limit, offset = compiler.whole_number(q.limit, "LIMIT"), compiler.whole_number(q.offset, "OFFSET")
        out = out.offset(offset) if offset else out
        out = out if limit is None else out.limit(limit)
        return out.select(*cols)

