"""Exact vector retrieval over chunk vectors, gates and their calibration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOP_FOR_MEAN, BLOCK, QUERY_BLOCK = 40, 16_384, 2_048


def unit(vec: Column) -> Column:
    """The vector at length 1; a zero vector as it is."""
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(vec, lambda x: x / F.when(norm == 0, 1.0).otherwise(norm))


def stale_documents(expected: DataFrame, held: DataFrame) -> DataFrame:
    """doc_ids whose held chunks (doc_id, chunk_no, sha) aren't exactly the expected ones."""
    e, h = expected.select("doc_id", "chunk_no", "sha", F.lit(1).alias("e")), held.select("doc_id", "chunk_no", "sha", F.lit(1).alias("h"))
    both = e.join(h, ["doc_id", "chunk_no", "sha"], "full_outer")
    return both.groupBy("doc_id").agg(F.max(F.coalesce("e", F.lit(0))).alias("wanted"), F.min(F.coalesce("e", F.lit(0)) * F.coalesce("h", F.lit(0))).alias("same")).where("wanted = 1 and same = 0").select("doc_id")


def coverage(expected: DataFrame, held: DataFrame) -> DataFrame:
    """One row: eligible documents, those embedded in full, held chunks, stale documents."""
    docs = expected.select("doc_id").distinct()
    stale = stale_documents(expected, held)
    a = docs.join(stale.withColumn("stale", F.lit(1)), "doc_id", "left").agg(F.count(F.lit(1)).alias("eligible"), F.count("stale").alias("stale"))
    return a.withColumn("embedded", F.col("eligible") - F.col("stale")).crossJoin(held.agg(F.count(F.lit(1)).alias("chunks")))  # one row each


def cosine_top(queries: DataFrame, chunks: DataFrame, n: int, lowest: bool = False) -> DataFrame:
    """(qid, doc_id, chunk_no, cos, rank): per query the first n documents by their best chunk, exactly.

    A few thousand queries, counted first, are a matrix that every task has: chunks are scanned where they are, and each
    batch gives at most n documents for a query. That is enough, as a document of the first n stands in the batch of its
    best chunk behind fewer than n others. With more queries, and for the farthest, rows and queries meet in blocks of
    bounded size. Ties go to the smaller document and the smaller chunk. lowest: the farthest instead. Where both tables have
    a column ``set``, one value for all chunks of a document, a query doesn't meet the documents of its own set: so a large
    part of all can be left out for each query without a row for each pair.
    """
    apart = "set" in queries.columns and "set" in chunks.columns
    if not lowest and not apart:
        few = queries.select("qid", "vec").limit(QUERY_BLOCK + 1).toPandas()
        if len(few) <= QUERY_BLOCK:
            return scanned(few, chunks, n)
    count = chunks.count()
    blocks, asked = 1 + count // BLOCK, 1 + queries.count() // QUERY_BLOCK
    sign = -1.0 if lowest else 1.0
    of = lambda d: (F.col("set") if "set" in d.columns else F.lit(None)).cast("string")
    data = chunks.select("doc_id", "chunk_no", F.col("vec"), of(chunks).alias("of"), F.pmod(F.xxhash64("doc_id"), F.lit(blocks).cast("long")).alias("block"))
    data = data.withColumn("asked", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(asked - 1).cast("long"))))
    q = queries.select("qid", F.col("vec").alias("asked_vec"), of(queries).alias("asked_of"), F.pmod(F.xxhash64("qid"), F.lit(asked).cast("long")).alias("asked"))
    q = q.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"qid": [], "doc_id": [], "chunk_no": [], "cos": []})
        left = left.sort_values(["doc_id", "chunk_no"], ignore_index=True)
        vecs, numbers = np.stack(left["vec"]).astype(float).T, left["chunk_no"].to_numpy()
        ids, start = np.unique(left["doc_id"].to_numpy(), return_index=True)
        ends = np.append(start[1:], len(left))
        sets = left["of"].to_numpy()[start]
        out = []
        for lo in range(0, len(right), 128):
            part = right.iloc[lo : lo + 128]
            cos = np.stack(part["asked_vec"]).astype(float) @ vecs
            best = np.round(np.maximum.reduceat(cos, start, axis=1), 9)
            for i, (qid, own) in enumerate(zip(part["qid"], part["asked_of"])):
                row = -sign * best[i]
                near = np.flatnonzero(sets != own) if apart else np.arange(len(ids))
                if len(near) > n:
                    near = near[row[near] <= np.partition(row[near], n - 1)[n - 1]]
                for j in near[np.lexsort((near, row[near]))[:n]]:
                    k = start[j] + int(np.argmax(np.round(cos[i, start[j] : ends[j]], 9)))
                    out.append((qid, ids[j], int(numbers[k]), float(cos[i, k])))
        return pd.DataFrame(out, columns=["qid", "doc_id", "chunk_no", "cos"])

    found = data.groupBy("block", "asked").cogroup(q.groupBy("block", "asked")).applyInPandas(meet, "qid long, doc_id long, chunk_no int, cos double")
    place = Window.partitionBy("qid").orderBy(F.round("cos", 6) if lowest else F.desc(F.round("cos", 6)), "doc_id")
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= n)


def scanned(queries: pd.DataFrame, chunks: DataFrame, n: int) -> DataFrame:
    """cosine_top for queries that fit a task."""
    schema = "qid long, doc_id long, chunk_no int, cos double"
    if not len(queries):
        return chunks.sparkSession.createDataFrame([], f"{schema}, rank int")
    shared = chunks.sparkSession.sparkContext.broadcast((queries["qid"].to_numpy(), np.stack(queries["vec"]).astype(float)))  # QUERY_BLOCK rows at most

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        qids, asked = shared.value
        for batch in batches:
            if not len(batch):
                continue
            batch = batch.sort_values(["doc_id", "chunk_no"], ignore_index=True)
            cos = asked @ np.stack(batch["vec"]).astype(float).T
            near = np.round(cos, 9)
            ids, start = np.unique(batch["doc_id"].to_numpy(), return_index=True)
            first = np.argsort(-np.maximum.reduceat(near, start, axis=1), axis=1, kind="stable")[:, :n]
            ends = np.append(start[1:], len(batch))
            q = np.repeat(np.arange(len(qids)), first.shape[1])
            docs = first.ravel()
            at = np.array([start[d] + int(near[i, start[d] : ends[d]].argmax()) for i, d in zip(q, docs)], np.int64)
            yield pd.DataFrame({"qid": qids[q], "doc_id": ids[docs], "chunk_no": batch["chunk_no"].to_numpy()[at], "cos": cos[q, at]})

    found = chunks.select("doc_id", "chunk_no", "vec").mapInPandas(scan, schema)
    best = F.min(F.struct((-F.round("cos", 9)).alias("c"), "chunk_no", "cos"))
    once = found.groupBy("qid", "doc_id").agg(best.alias("b")).select("qid", "doc_id", "b.chunk_no", "b.cos")
    place = Window.partitionBy("qid").orderBy(F.desc(F.round("cos", 6)), "doc_id")
    return once.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= n)


def relative(top: DataFrame, weights: DataFrame) -> DataFrame:
    """(qid, doc_id, cos, ratio, rank): cosine over the mean of the query's first 40, times the feedback penalty (weights
    under 1), ordered by the penalised cosine; 0 where the cosine isn't positive."""
    mean = F.avg("cos").over(Window.partitionBy("qid"))
    r = top.where(F.col("rank") <= TOP_FOR_MEAN).withColumn("mean", mean).join(weights, "doc_id", "left")
    penalty = F.greatest(F.least(F.coalesce("weight", F.lit(1.0)), F.lit(1.0)), F.lit(0.0))
    priority = F.when(F.col("cos") >= 0, F.col("cos") * penalty).otherwise(F.col("cos"))
    ratio = F.when((F.col("cos") > 0) & (F.col("mean") > 0), F.col("cos") / F.col("mean") * penalty).otherwise(0.0)
    place = Window.partitionBy("qid").orderBy(F.desc(F.round(priority, 6)), "doc_id")
    return r.select("qid", "doc_id", "cos", ratio.alias("ratio"), F.row_number().over(place).alias("rank"))


def agreed(words: DataFrame, meaning: DataFrame, k: int, floor: float) -> DataFrame:
    """(qid, doc_id, place): in both lanes' first k with a ratio at or above the floor; better rank, then the sum."""
    w = words.where(F.col("rank") <= k).select("qid", "doc_id", F.col("rank").alias("w"))
    m = meaning.where((F.col("rank") <= k) & (F.col("ratio") >= floor)).select("qid", "doc_id", F.col("rank").alias("m"))
    place = Window.partitionBy("qid").orderBy(F.least("w", "m"), F.col("w") + F.col("m"), "w")
    return w.join(m, ["qid", "doc_id"]).select("qid", "doc_id", F.row_number().over(place).alias("place"))


def gate(controls: DataFrame, allow: int = 0, margin: float = 0.01) -> DataFrame:
    """One row: the highest first-hit ratio of the control queries but for ``allow`` of them, plus a margin."""
    first = controls.where("rank = 1").select("qid", "ratio").orderBy(F.desc("ratio"), "qid").limit(allow + 1)
    return first.agg(F.count(F.lit(1)).alias("n"), F.min("ratio").alias("ratio")).where(F.col("n") == allow + 1).select((F.col("ratio") + margin).alias("floor"))


def kept_positives(results: DataFrame, gold: DataFrame, floor: DataFrame) -> DataFrame:
    """One row (queries, top_1, top_3): positive queries of whose gold a row at or above the gate is first, or in the first three."""
    met = results.join(gold, ["qid", "doc_id"]).crossJoin(F.broadcast(floor)).where("ratio >= floor")  # one row
    best = gold.select("qid").distinct().join(met.groupBy("qid").agg(F.min("rank").alias("rank")), "qid", "left")
    return best.agg(F.count(F.lit(1)).alias("queries"), F.count(F.when(F.col("rank") == 1, 1)).alias("top_1"), F.count(F.when(F.col("rank") <= 3, 1)).alias("top_3"))
