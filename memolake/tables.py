"""Tables in the folder that driver and executors share: they cut lineage, and lost executors cost nothing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset, a folder of our own if all runs on one machine, as in tests."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("memolake.shared.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="memolake-")
        spark.conf.set("memolake.shared.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/memolake-{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again.

    The table stays for as long as the shared folder does, as what is returned may read it, or until it is released.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.staged_path = path
    return table


def released(*tables: DataFrame) -> None:
    """Remove staged tables that nothing reads any more; other DataFrames are left alone."""
    for t in tables:
        if path := vars(t).get("staged_path"):
            hadoop = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(hadoop, True)


def little(df: DataFrame, rows: int) -> DataFrame:
    """df marked to be broadcast if it has no more than so many rows, which is counted; else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def numbered(df: DataFrame, *order: Column | str) -> DataFrame:
    """df with ``number``, from 0 without gaps in that order: its place in the partition after the rows of those before it."""
    d = staged(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    sizes = d.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row for each partition
    d = d.withColumn("_part", part).join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part")
    return d.withColumn("number", F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_part", "_before")
