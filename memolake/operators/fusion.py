"""Fusing ranked lanes and reading judged answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K, POOL = 60, 20


def reciprocal(lanes: list[DataFrame], k: int, pool: int = POOL) -> DataFrame:
    """(qid, doc_id, score, rank): lanes (qid, doc_id, rank) by the sum of 1 / (60 + rank); ties by document."""
    rows = reduce(DataFrame.unionByName, [x.select("qid", "doc_id", "rank").where(F.col("rank") <= pool) for x in lanes])
    fused = rows.groupBy("qid", "doc_id").agg(F.sum(F.lit(1.0) / (RRF_K + F.col("rank"))).alias("score"))
    place = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "doc_id")
    return fused.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)


def better_rank(words: DataFrame, meaning: DataFrame, k: int, pool: int = POOL) -> DataFrame:
    """(qid, doc_id, rank): the better rank wins, then the sum of ranks, then the words' rank. A missing rank is last."""
    w = words.where(F.col("rank") <= pool).select("qid", "doc_id", F.col("rank").alias("w"))
    m = meaning.where(F.col("rank") <= pool).select("qid", "doc_id", F.col("rank").alias("m"))
    none = F.lit(pool + 1)
    both = w.join(m, ["qid", "doc_id"], "full_outer").select("qid", "doc_id", F.coalesce("w", none).alias("w"), F.coalesce("m", none).alias("m"))
    place = Window.partitionBy("qid").orderBy(F.least("w", "m"), F.col("w") + F.col("m"), "w", "doc_id")
    return both.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("qid", "doc_id", "rank")


def parsed_answers(answers: DataFrame) -> DataFrame:
    """(key, i, score) of answers (key, text, n): a JSON array of {i, s}, alone or within prose; the last of repeated i
    counts, scores outside 0..10 and i outside 1..n don't, and what can't be read gives no rows."""
    array = F.from_json(F.regexp_extract("text", r"(?s)(\[.*\])", 1), "array<struct<i:int,s:double>>")
    rows = answers.select("key", "n", F.posexplode(array).alias("at", "x")).select("key", "n", "at", "x.i", "x.s")
    rows = rows.where((F.col("i") >= 1) & (F.col("i") <= F.col("n")) & F.col("s").between(0, 10))
    return rows.groupBy("key", "i").agg(F.max_by("s", "at").alias("score"))


def answer_counts(answers: DataFrame) -> DataFrame:
    """(key, readable, answered, duplicates, out_of_range) of answers (key, text, n): readable is false where no array can be read,
    and the counts are null then, not 0."""
    array = F.from_json(F.regexp_extract("text", r"(?s)(\[.*\])", 1), "array<struct<i:int,s:double>>")
    a = answers.select("key", "n", array.alias("a"))
    wrong = lambda x: ~F.coalesce(x["i"].between(F.lit(1), F.col("n")) & x["s"].between(0, 10), F.lit(False))
    good = F.filter("a", lambda x: ~wrong(x))
    once = F.size(F.array_distinct(F.transform(good, lambda x: x["i"])))
    ok = F.col("a").isNotNull()
    return a.select("key", ok.alias("readable"), F.when(ok, once).alias("answered"), F.when(ok, F.size(good) - once).alias("duplicates"), F.when(ok, F.size(F.filter("a", wrong))).alias("out_of_range"))


def placed_threshold(scores: DataFrame, controls: DataFrame) -> DataFrame:
    """One row (t, mass, blocked): place_threshold over the noise of control scores; blocked where a control has full marks."""
    top = controls.agg(F.coalesce(F.max("score"), F.lit(0.0)).alias("noise")).first()["noise"]
    return place_threshold(scores, top).select("t", "mass", F.lit(top >= 10).alias("blocked"))


def place_threshold(scores: DataFrame, noise: float) -> DataFrame:
    """One row: the whole number from noise + 1 to 10 with the least scores on it or just under it, the lower on ties."""
    spark = scores.sparkSession
    counts = scores.groupBy(F.round("score").cast("int").alias("s")).agg(F.count(F.lit(1)).alias("n"))
    grid = spark.range(11).select(F.col("id").cast("int").alias("t")).where(F.col("t") >= noise + 1)
    mass = grid.join(counts, F.col("s").isin(F.col("t"), F.col("t") - 1), "left").groupBy("t").agg(F.sum(F.coalesce("n", F.lit(0))).alias("mass"))
    return mass.agg(F.min(F.struct("mass", "t")).alias("m")).select("m.t", "m.mass")


def best_judged(judged: DataFrame, floor: float) -> DataFrame:
    """(qid, doc_id, top, second, ties): the best judged candidate of each query where it reaches the floor."""
    of = Window.partitionBy("qid")
    r = judged.withColumn("place", F.row_number().over(of.orderBy(F.desc("score"), "doc_id"))).withColumn("top", F.max("score").over(of))
    out = r.groupBy("qid").agg(F.max(F.when(F.col("place") == 1, F.col("doc_id"))).alias("doc_id"), F.max("top").alias("top"), F.max(F.when(F.col("place") == 2, F.col("score"))).alias("second"), F.count(F.when(F.col("score") == F.col("top"), 1)).alias("ties"))
    return out.where(F.col("top") >= floor)
