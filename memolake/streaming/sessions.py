"""Streams of logs: incremental scans, session tails, dead sessions, completed days, index upkeep."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memolake.operators import index

KEEP = 12


def log_stream(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", files: int = 16) -> DataFrame:
    """Files of a folder as they come; offsets are in the query's checkpoint, so a restart goes on where it stopped."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(fmt).load(path)


def completed_days(log: DataFrame, late: str = "1 hour") -> DataFrame:
    """(day, n, users): each day once, when it is over; what comes later than the delay is dropped."""
    day = log.withWatermark("ts", late).groupBy(F.window("ts", "1 day"))
    return day.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("user_id").alias("users")).select(F.col("window.start").alias("day"), "n", "users")


def dead_sessions(log: DataFrame, idle: str = "1 hour", least: int = 3, late: str = "10 minutes") -> DataFrame:
    """(user_id, start, end, writes): sessions that have gone idle with so many writes or more."""
    s = log.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", idle).alias("s"))
    return s.agg(F.count(F.when(F.col("event_type") == "click", 1)).alias("writes")).where(F.col("writes") >= least).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "writes")


def first_observations(log: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    return log.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def session_tails(log: DataFrame) -> DataFrame:
    """(user_id, writes, turns): after each batch, what each user's session has since the last save: the number of writes
    and the last 12 event ids. A save empties the tail. State is the tail alone, of bounded size."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        writes, turns = state.get if state.exists else (0, "")
        turns = [x for x in turns.split(",") if x]
        rows = pd.concat([*batches]).sort_values(["ts", "event_id"])
        for kind, event in zip(rows["event_type"], rows["event_id"]):
            if kind == "purchase":
                writes, turns = 0, []
            else:
                writes += kind == "click"
                turns = [*turns, str(event)][-KEEP:]
        state.update((int(writes), ",".join(turns)))
        yield pd.DataFrame({"user_id": [key[0]], "writes": [int(writes)], "turns": [",".join(turns)]})

    return log.groupBy("user_id").applyInPandasWithState(step, "user_id long, writes long, turns string", "writes long, turns string", "update", "NoTimeout")


def keep_index(changes: DataFrame, path: str, checkpoint: str, buckets: int = 16):
    """Keeps an index up to date with a stream of changed documents (doc_id, ts, name, title, description, body; a null body:
    removed), the last change of a document in a batch counts. Batch n writes version n + 1; see ``index.kept``."""

    def merge(batch: DataFrame, epoch: int) -> None:
        last = batch.groupBy("doc_id").agg(F.max_by(F.struct(*[c for c in batch.columns if c != "doc_id"]), "ts").alias("d")).select("doc_id", "d.*")
        index.kept(last, path, epoch + 1, buckets)

    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
