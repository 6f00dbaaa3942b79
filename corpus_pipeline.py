"""Corpus pipeline: toxicity, language, near duplicates, packing. Each stage is written as Parquet and reread by the next.

Stages decide row by row; documents need the columns doc_id and text, and lang to learn languages. All others are carried along,
whatever their names. Rows that repeat an id, and rows without one, are rows like any others. An empty table stays empty.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.llm import langid, minhash, packing, toxicity
from halyard.llm.common import read, written


def _free(docs: DataFrame, name: str) -> str:
    """A column name that the documents do not have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _only(kept: DataFrame, docs: DataFrame) -> DataFrame:
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text scores 0.5 or more go. Null and empty texts have no match and stay."""
    score = _free(docs, "score")
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    return _only(docs.withColumn(score, toxicity.scorer(model)).filter(F.col(score) < 0.5), docs)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters (null and empty ones too) go, and texts with too many byte pairs that no training text has: junk and
    unlearned scripts. Without training rows every row goes, as no language is known."""
    rows = langid.sample(docs)
    known, most = langid.known_pairs(rows)
    found, strange = _free(docs, "found"), _free(docs, "strange")
    out = docs.withColumns({found: langid.predictor(langid.fit(rows)), strange: langid.strangeness(known)})
    return _only(out.filter((F.col(found)["lang_pred"] != langid.UND) & (F.col(strange) <= most)), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays: the smallest id, nulls last, of rows that repeat it any one. Rows without words are alike to none
    and stay. Rows are told apart by a number of their own, as ids may repeat or be null."""
    row = _free(docs, "row")
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")  # written, so that the numbers stay the same
    found = minhash.near_duplicates(rows, key=row).select(F.col(row).alias("r"), "component_id")
    ids = rows.select(F.col(row).alias("r"), "doc_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "r"))
    keep = found.join(ids, "r").groupBy("component_id").agg(first.alias("first")).select(F.col("first.r").alias(row))
    return _only(rows.join(keep, row, "left_semi"), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's bucket, batch and place; null and empty texts have length 0."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("language", drop_unknown_language), ("near_duplicates", drop_near_duplicates), ("packing", pack)]

#: Learned models and MinHash cannot be said in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
