"""What the operators share: the shared folder, written tables, the hold-out rule and word boundaries."""

import ctypes
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.sources.shared import remove, scratch

#: A word is a run of anything but these: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE_CLASS = r"\\x20\\x09-\\x0D"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: lineage ends here, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._halyard_path = path
    return out


def drop_written(df: DataFrame) -> None:
    """Free a written table that no result still reads."""
    remove(df.sparkSession, df._halyard_path)


def fold(key: str, n: int) -> Column:
    """crc32 of the key as text, modulo n. A null key gives null."""
    return F.pmod(F.crc32(F.col(key).cast("string")), F.lit(n))


#: Bytes of a batch that goes to a Python worker, unless the session sets its own; the JVM and the worker both hold copies of it.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_SPARKS_OWN = "67108864b"


def small_batches(spark: SparkSession) -> None:
    """Bound the memory of Arrow passes. A text longer than this makes a batch of its own."""
    if spark.conf.get(_BATCH, _SPARKS_OWN) == _SPARKS_OWN:
        spark.conf.set(_BATCH, BATCH_BYTES)


def tidy() -> None:
    """Give freed memory back to the system: Python workers live on between stages, and what they keep adds up."""
    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def tidied(batches: Iterator) -> Iterator:
    for b in batches:
        yield b
        del b
        tidy()
