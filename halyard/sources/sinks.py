"""Result sinks."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    """Arrays become `[a b ...]` text, structs `POINT(lat lon)`."""
    cols = []
    for name, kind in df.dtypes:
        if kind.startswith("array"):
            cols.append(F.concat(F.lit("["), F.array_join(F.col(name).cast("array<string>"), " "), F.lit("]")).alias(name))
        elif kind.startswith("struct<lat:"):
            cols.append(F.concat(F.lit("POINT("), F.col(f"{name}.lat").cast("string"), F.lit(" "), F.col(f"{name}.lon").cast("string"), F.lit(")")).alias(name))
        else:
            cols.append(F.col(name))
    df.select(*cols).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
