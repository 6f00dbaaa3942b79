"""Table definitions and committed snapshots.

A snapshot maps each table to its definition and to the Parquet folders that hold its rows. Each commit writes a manifest under a
temporary name and then gives it the next number without replacing what is there, so two writers cannot commit the same number and
no reader sees half a manifest. (Object stores have no such rename; there a single writer at a time is needed.) Folders are never
changed or removed by a commit, so open readers of older snapshots go on; `vacuum` removes what no recent snapshot names.
"""

import json
import os
import re
import time
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from halyard.plans.parser import SqlError

_INT, _LONG = ("int", "integer", "int32"), ("bigint", "long", "int64")


@dataclass
class Column:
    name: str
    kind: str  # int, long, bool, text, bytes, point, vector
    size: int | None = None
    not_null: bool = False

    @property
    def spark(self) -> T.DataType:
        point = T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())])
        return {"int": T.IntegerType(), "long": T.LongType(), "bool": T.BooleanType(), "text": T.StringType(), "bytes": T.BinaryType(), "point": point, "vector": T.ArrayType(T.FloatType())}[self.kind]


@dataclass
class Index:
    name: str
    kind: str
    column: str
    options: dict = field(default_factory=dict)
    unique: bool = False
    centroids: list = field(default_factory=list)  # of an IVF index: at most 4096 vectors
    parts: dict[str, str] = field(default_factory=dict)  # folder of rows: folder of the same rows by list


@dataclass
class Table:
    name: str
    columns: list[Column]
    key: list[str]
    uniques: list[list[str]] = field(default_factory=list)
    indexes: list[Index] = field(default_factory=list)
    clustered: bool = False
    folders: list[str] = field(default_factory=list)

    def column(self, name: str) -> Column:
        for c in self.columns:
            if c.name.lower() == name.lower():
                return c
        raise SqlError(f"no column {name!r} in {self.name!r}")

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.spark, metadata={"max_len": c.size} if c.size and c.kind != "vector" else {"dim": c.size} if c.size else {}) for c in self.columns])

    @staticmethod
    def load(d: dict) -> "Table":
        return Table(**d | {"columns": [Column(**c) for c in d["columns"]], "indexes": [Index(**i) for i in d["indexes"]]})


def make_column(name: str, kind: str, size: int | None, not_null: bool) -> Column:
    if kind in _INT:
        return Column(name, "int", None, not_null)
    if kind in _LONG:
        return Column(name, "long", None, not_null)
    if kind in ("bool", "boolean"):
        return Column(name, "bool", None, not_null)
    if kind in ("text", "string", "varchar", "char"):
        return Column(name, "text", size or 255, not_null)
    if kind == "varbinary":
        return Column(name, "bytes", size or 255, not_null)
    if kind in ("blob", "bytes"):
        return Column(name, "bytes", 4096, not_null)
    if kind == "point":
        return Column(name, "point", None, not_null)
    if kind in ("vector", "vector32", "embedding"):
        if not size:
            raise SqlError(f"{name}: a vector needs its dimension")
        return Column(name, "vector", size, not_null)
    raise SqlError(f"type not supported: {kind}")


class Store:
    """Manifests and row folders under one path of any Hadoop file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.path).getFileSystem(self._conf)
        self.fs.mkdirs(self._path(f"{self.path}/_manifests"))

    def _numbers(self) -> list[int]:
        files = self.fs.listStatus(self._path(f"{self.path}/_manifests"))
        return sorted(int(n[:-5]) for n in (f.getPath().getName() for f in files) if re.fullmatch(r"\d+\.json", n))

    def _load(self, number: int) -> dict | None:
        """The manifest's content; None if it is not complete."""
        stream = self.fs.open(self._path(f"{self.path}/_manifests/{number:012d}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            return json.loads(text)
        except ValueError:
            return None

    def latest(self) -> int:
        """Number of the last complete manifest, 0 before the first."""
        return next((n for n in reversed(self._numbers()) if self._load(n) is not None), 0)

    def read(self, number: int) -> dict[str, Table]:
        return {k: Table.load(v) for k, v in (self._load(number) or {}).items()} if number else {}

    def commit(self, base: int, tables: dict[str, Table]) -> bool:
        """Make these tables the snapshot after `base`; False if another writer was first."""
        there = self._numbers()
        if any(n > base and self._load(n) is not None for n in there):
            return False
        folder = f"{self.path}/_manifests"
        draft, at = f"{folder}/_{uuid.uuid4().hex}.tmp", f"{folder}/{max([base, *there]) + 1:012d}.json"
        out = self.fs.create(self._path(draft), False)
        try:
            out.write(bytearray(json.dumps({k: asdict(v) for k, v in tables.items()}).encode()))
        finally:
            out.close()
        try:
            return self._publish(draft, at)
        finally:
            self.fs.delete(self._path(draft), False)

    def _publish(self, draft: str, at: str) -> bool:
        if self.fs.getScheme() == "file":  # a hard link is atomic and never replaces
            local = [self.spark._jvm.java.net.URI(self.fs.makeQualified(self._path(p)).toString()).getPath() for p in (draft, at)]
            try:
                os.link(*local)
            except FileExistsError:
                return False
            return True
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        context = hadoop.FileContext.getFileContext(self.fs.getUri(), self._conf)
        none = self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)
        try:
            context.rename(self._path(draft), self._path(at), none)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def write(self, table: Table, df: DataFrame) -> str:
        """Rows in a new folder; clustered tables are sorted by key so that a scan can skip row groups."""
        folder = f"{self.path}/{table.name}/{uuid.uuid4().hex}"
        hashed = next((i.column for i in table.indexes if i.kind == "hash"), None)
        ordered = next((i.column for i in table.indexes if i.kind == "btree"), None)
        if table.clustered or ordered:  # Parquet then skips files and row groups by their bounds
            by = table.key if table.clustered else [ordered]
            df = df.repartitionByRange(*by).sortWithinPartitions(*by)
        elif hashed:  # equal values share a file
            df = df.repartition(hashed).sortWithinPartitions(hashed)
        df.select([F.col(f"`{c.name}`") for c in table.columns]).write.parquet(folder)
        return folder

    def frame(self, table: Table) -> DataFrame:
        if not table.folders:
            return self.spark.createDataFrame([], table.schema)
        return self.spark.read.schema(table.schema).parquet(*table.folders)

    def vacuum(self, seconds: float = 7 * 86400) -> list[str]:
        """Remove folders older than so many seconds that no snapshot of that time names; readers of older snapshots end by then."""
        cut, known = (time.time() - seconds) * 1000, set()
        numbers = self._numbers()
        for f in self.fs.listStatus(self._path(f"{self.path}/_manifests")):
            name = f.getPath().getName()
            if re.fullmatch(r"\d+\.json", name) and (f.getModificationTime() >= cut or int(name[:-5]) == numbers[-1]):
                for t in self.read(int(name[:-5])).values():
                    known |= {x.rsplit("/", 1)[1] for x in [*t.folders, *(p for i in t.indexes for p in i.parts.values())]}
        gone = []
        for top in self.fs.listStatus(self._path(self.path)):
            if top.isDirectory() and top.getPath().getName() != "_manifests":
                for f in self.fs.listStatus(top.getPath()):
                    if f.getModificationTime() < cut and f.getPath().getName() not in known:
                        gone.append(str(f.getPath()))
                        self.fs.delete(f.getPath(), True)
        return gone
