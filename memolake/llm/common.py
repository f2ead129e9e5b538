"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memolake.tables import fresh_path, released, staged

__all__ = ["fresh_path", "released", "give_back", "small_batches", "staged", "table", "int_hash", "input_partitions", "WORD", "UPPER", "LOWER"]

#: A word is a run of anything but the ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def int_hash(text: Column, chars: int = 8) -> Column:
    """The first hexadecimal digits of the MD5 as a long: the same number in any SQL engine."""
    return F.conv(F.substring(F.md5(text), 1, chars), 16, 10).cast("long")


def small_batches(docs: DataFrame, rows: int = 1000) -> DataFrame:
    """docs, whose texts go to Python in batches of so many rows: Spark's default of 10,000 holds hundreds of MB of long texts
    in the worker and once more in the executor. It is a setting of the session, as is a smaller one that is already there."""
    conf, key = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= rows:
        conf.set(key, str(rows))
    return docs


def give_back() -> None:
    """Hand memory that Python has freed back to the system, where the C library can. A worker goes on with the tasks of later
    stages, and what earlier ones freed counts against the executor until then."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def input_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
