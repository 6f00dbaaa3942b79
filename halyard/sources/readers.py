"""CSV, JSONL and JSON readers with bad rows split off."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from halyard.functions import spatial as S
from halyard.functions import vector as V


def _cast(name: str, kind: str) -> str:
    raw = f"trim(`{name}`)"
    plain = f"regexp_replace({raw}, '^[\\'\"]|[\\'\"]$', '')"
    kind = kind.lower()
    if kind in ("int", "integer", "bigint", "long"):
        return f"try_cast({raw} AS {'INT' if kind.startswith('int') else 'BIGINT'})"
    if kind in ("bool", "boolean"):
        return f"CASE lower({raw}) WHEN 'true' THEN true WHEN '1' THEN true WHEN 'false' THEN false WHEN '0' THEN false END"
    if kind == "point":
        return S.point_from_text(plain)
    if kind.startswith("vector"):
        return V.from_text(plain)
    return plain


def read_csv(spark: SparkSession, path: str, columns: list[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """(good, bad) rows of a CSV file by position; the header row is dropped, extra fields are ignored, short rows are bad.

    columns: (name, type), types int, bigint, bool, text, point, vector. bad has `_row` and `_error`.
    """
    n = len(columns)
    wide = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(n)] + [T.StructField("_row", T.StringType())])
    raw = spark.read.schema(wide).option("header", True).option("enforceSchema", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_row").csv(path)
    # an empty cell is an empty text; a row of another number of fields comes with its text, in which the fields are counted
    typed = raw.withColumns({f"c{i}": F.coalesce(f"c{i}", F.lit("")) for i in range(n)})
    typed = typed.withColumns({f"__{c}": F.expr(_cast(f"c{i}", kind)) for i, (c, kind) in enumerate(columns)})
    bare = "regexp_replace(_row, '\"([^\"]|\"\")*\"', '')"
    missing = f"_row IS NOT NULL AND length({bare}) - length(replace({bare}, ',', '')) < {n - 1}"
    wrong = F.array_compact(F.array(*[F.when(F.col(f"__{c}").isNull(), F.lit(c)) for c, _ in columns]))
    typed = typed.withColumn("_error", F.when(F.expr(missing), F.lit("too few fields")).when(F.size(wrong) > 0, F.concat(F.lit("bad value in "), F.array_join(wrong, ", "))))
    good = typed.filter("_error IS NULL").select(*[F.col(f"__{c}").alias(c) for c, _ in columns])
    bad = typed.filter("_error IS NOT NULL").select(F.coalesce("_row", F.concat_ws(",", *[f"c{i}" for i in range(n)])).alias("_row"), "_error")
    return good, bad


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(id, text) rows; a repeated id raises an error when read. A missing id becomes one made of the file's name, the text and, among
    equal texts of a file, a number, so it does not change with the split of the files."""
    from pyspark.sql import Window

    df = spark.read.schema("id string, text string").json(path).withColumn("__file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    made = F.concat(F.lit("row-"), F.lower(F.hex(F.xxhash64("__file", "text"))))
    same = F.row_number().over(Window.partitionBy("__file", "text", "id").orderBy(F.lit(0)))
    named, rest = df.filter("id IS NOT NULL").drop("__file"), df.filter("id IS NULL")
    df = named.unionByName(rest.withColumn("id", F.concat(made, F.lit("-"), same)).drop("__file"))
    n = F.count("*").over(Window.partitionBy("id"))
    return df.withColumn("id", F.when(n > 1, F.raise_error(F.concat(F.lit("duplicate id "), "id"))).otherwise(F.col("id")))


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, doc) from one JSON object {query: [docs]}."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, array<string>>").alias("m"))
    return raw.select(F.explode("m").alias("query_id", "docs")).select("query_id", F.explode("docs").alias("doc"))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, text) from a JSON list of {id, text}."""
    return spark.read.option("multiLine", True).schema("id string, text string").json(path).withColumnRenamed("id", "query_id")


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, content) of binary files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")
