"""Calibration and evaluation of retrieval."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memolake.functions import text as T
from memolake.functions.runs import Letters, Runs
from memolake.operators.lexical import FEW, held_terms
from memolake.tables import little, staged

#: So many texts of a table meet as many of another in one task.
ALIKE_BLOCK = 256


def containment_gold(queries: DataFrame, docs: DataFrame, terms: DataFrame, posted: DataFrame) -> DataFrame:
    """(qid, doc_id): documents that hold the query's text as it is. A query meets the documents that have its rarest inner
    word (the first and the last one may be cut in the text), then is compared; one without an inner word meets those in
    one of whose terms its longest word stands. A query without words has no gold."""
    w = T.words(F.col("text"))
    inner = F.array_distinct(F.when(F.size(w) > 2, F.slice(w, 2, F.size(w) - 2)).otherwise(F.array().cast("array<string>")))
    asked = queries.select("qid", "text", w.alias("w"), inner.alias("inner"))
    by_word = asked.select("qid", F.explode("inner").alias("word")).select("qid", F.explode(T.grams(F.col("word"))).alias("term")).join(terms, "term")
    rarest = by_word.groupBy("qid").agg(F.min(F.struct("df", "term")).alias("r")).select("qid", F.col("r.term").alias("term"))
    short = asked.where(F.size("inner") == 0).select("qid", F.try_element_at(F.array_sort("w", lambda a, b: F.length(a) - F.length(b)), F.lit(-1)).alias("word")).where("word is not null")
    part = short.join(held_terms(short, terms), "word").select("qid", "term")
    met = posted.select("doc_id", "term").join(little(rarest.unionByName(part), FEW), "term").select("qid", "doc_id").distinct()
    return met.join(queries.select("qid", "text"), "qid").join(docs.select("doc_id", "body"), "doc_id").where(F.contains("body", "text")).select("qid", "doc_id")


def gold_ranks(results: DataFrame, gold: DataFrame) -> DataFrame:
    """(qid, rank): the best rank of a query's gold, null where none was found."""
    return gold.join(results.select("qid", "doc_id", "rank"), ["qid", "doc_id"], "left").groupBy("qid").agg(F.min("rank").alias("rank"))


def metrics(results: DataFrame, gold: DataFrame) -> DataFrame:
    r = gold_ranks(results, gold)
    at = lambda k: F.round(F.avg((F.coalesce("rank", F.lit(99)) <= k).cast("int")), 6)
    return r.agg(F.count(F.lit(1)).alias("n"), at(1).alias("hit_1"), at(3).alias("hit_3"), at(8).alias("hit_8"), F.round(F.avg(F.coalesce(F.lit(1.0) / F.col("rank"), F.lit(0.0))), 6).alias("mrr"))


def sweep(results: DataFrame, gold: DataFrame, positive: Column, thresholds: list[float]) -> DataFrame:
    """Per threshold: hits of positive queries, fires of the others, and hit rate * (1 - false fire rate)."""
    spark = results.sparkSession
    marked = results.join(gold.withColumn("hit", F.lit(True)), ["qid", "doc_id"], "left")
    top = marked.groupBy("qid").agg(F.max("score").alias("score"), F.max(F.coalesce("hit", F.lit(False))).alias("hit")).withColumn("positive", positive)
    t = F.broadcast(spark.createDataFrame([(x,) for x in thresholds], "threshold double"))  # a short list
    fires = F.col("score") >= F.col("threshold")
    out = top.crossJoin(t).groupBy("threshold").agg(
        F.count(F.when(F.col("positive") & F.col("hit") & fires, 1)).alias("hits"), F.count(F.when(~F.col("positive") & fires, 1)).alias("false_fires"),
        F.count(F.when(F.col("positive"), 1)).alias("a"), F.count(F.when(~F.col("positive"), 1)).alias("c"),
    )
    return out.select("threshold", "hits", "false_fires", F.round(F.col("hits") / F.col("a") * (1 - F.col("false_fires") / F.col("c")), 6).alias("auto"))


def noise_floor(results: DataFrame, controls: Column, margin: float = 1.35, least: float = 1.5) -> DataFrame:
    """One row: the highest first score of the control queries, and the threshold above it."""
    floor = results.where(controls).agg(F.max("score").alias("floor"))
    return floor.select(F.round("floor", 6).alias("floor"), F.greatest(F.lit(least), F.round(F.col("floor") * margin, 2)).alias("threshold"))


def miss_bands(results: DataFrame, gold: DataFrame) -> DataFrame:
    """(band, n) of the gold's rank: 1-3, 4-10, 11-30, 31-100, absent."""
    r = F.col("rank")
    band = F.when(r <= 3, "1-3").when(r <= 10, "4-10").when(r <= 30, "11-30").when(r <= 100, "31-100").otherwise("absent")
    return gold_ranks(results, gold).groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"))


def paired(cases: DataFrame, resamples: int = 200) -> DataFrame:
    """One row for (case, a, b): cases improved and made worse by b, mean difference, and a 95 % interval of the mean by
    seeded resampling: the i-th pick of resample r is a number made of both, so every engine draws alike.

    Cases are numbered by ranges: sorted by case, each partition's rows are counted, and a row's number is its place in the
    partition after those before it. Picks and cases meet by a join on the number.
    """
    spark = cases.sparkSession
    d = staged(cases.select("case", (F.col("b") - F.col("a")).alias("d")).repartitionByRange("case").sortWithinPartitions("case").withColumn("at", F.monotonically_increasing_id()), "cases")
    part = F.shiftright("at", 33)
    sizes = d.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row for each partition
    numbered = d.withColumn("part", part).join(F.broadcast(sizes.withColumn("before", before)), "part").select((F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("i"), "d")
    n = d.count()
    draws = spark.range(resamples * n).select((F.col("id") % resamples).alias("r"), F.floor(F.col("id") / resamples).alias("k"))
    pick = F.conv(F.substring(F.md5(F.concat_ws(":", "r", "k")), 1, 8), 16, 10).cast("long") % max(n, 1)
    means = draws.select("r", pick.alias("i")).join(little(numbered, FEW), "i").groupBy("r").agg(F.avg("d").alias("m"))
    place = means.select("m", F.row_number().over(Window.orderBy("m")).alias("p"))  # one row for each resample
    ends = place.agg(F.round(F.max(F.when(F.col("p") == int(0.025 * resamples + 0.999), F.col("m"))), 6).alias("low"), F.round(F.max(F.when(F.col("p") == int(0.975 * resamples + 0.999), F.col("m"))), 6).alias("high"))
    whole = numbered.agg(F.count(F.when(F.col("d") > 0, 1)).alias("improved"), F.count(F.when(F.col("d") < 0, 1)).alias("worse"), F.round(F.avg("d"), 6).alias("mean"))
    return whole.crossJoin(ends)  # one row each


def common_word_queries(term_df: DataFrame, n_docs: int, words: int = 4, most: int = 8, share: float = 0.25) -> DataFrame:
    """(qid, text): queries of the commonest terms, four to each; terms of two characters or more in a quarter of the documents,
    and at least in four."""
    common = term_df.where((F.length("term") >= 2) & (F.col("df") >= max(4, int(n_docs * share)))).orderBy(F.desc("df"), "term").limit(words * most)
    d = common.withColumn("i", F.row_number().over(Window.orderBy(F.desc("df"), "term")) - 1)  # a short list
    q = d.groupBy(F.floor(F.col("i") / words).alias("qid")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "term"))), lambda x: x["term"]).alias("t"))
    return q.where(F.size("t") == words).select("qid", F.array_join("t", " ").alias("text"))


def word_salad(term_df: DataFrame, n_docs: int, words: int = 3, queries: int = 14, pool: int = 120, seed: int = 23) -> DataFrame:
    """(qid, text): senseless queries of three of the corpus's more frequent terms (in 2 to 25 % of the documents), by hash."""
    low, high = max(3, int(n_docs * 0.02)), max(4, int(n_docs * 0.25))
    some = term_df.where(F.col("df").between(low, high) & (F.length("term") >= 2)).orderBy(F.desc("df"), "term").limit(pool)
    made = some.crossJoin(F.broadcast(term_df.sparkSession.range(queries).withColumnRenamed("id", "qid")))  # two short lists
    toss = F.md5(F.concat_ws(":", F.lit(seed), "qid", "term"))
    d = made.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(toss))).where(F.col("r") <= words)
    return d.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "term"))), lambda x: x["term"]), " ").alias("text"))


def fragments(docs: DataFrame, n: int = 60, words: int = 5, body: int = 400, seed: int = 7) -> DataFrame:
    """(doc_id, text) of docs (doc_id, name, body): for documents of over so many characters, the first five words of a sentence
    of 26 to 159 characters, without the words of the document's name, where four are left; the sentence and then the n
    documents are chosen by hash, equal fragments once."""
    own = T.words(F.regexp_replace("name", "_", " "))
    cut = F.transform(F.split("body", "[.!?\n。！？…·]"), lambda s: F.trim(s))
    d = docs.where(F.length("body") > body).select("doc_id", own.alias("own"), F.posexplode(cut).alias("i", "s")).where(F.length("s").between(26, 159))
    d = d.withColumn("w", F.filter(T.words(F.col("s")), lambda w: ~F.array_contains("own", w))).where(F.size("w") >= 4)
    toss = F.md5(F.concat_ws(":", F.lit(seed), "doc_id", "i"))
    one = d.groupBy("doc_id").agg(F.min_by(F.array_join(F.slice("w", 1, words), " "), toss).alias("text"))
    first = one.groupBy("text").agg(F.min("doc_id").alias("doc_id"))
    return first.orderBy(F.md5(F.concat_ws(":", F.lit(seed), "doc_id")), "doc_id").limit(n).select("doc_id", "text")


def deployable(tries: DataFrame, incumbents: DataFrame, margin: float = 0.02) -> DataFrame:
    """(threshold, auto, best, allowed): a new threshold's auto value against the best of those in use (threshold, auto); it is
    refused if it stays more than the margin below."""
    best = incumbents.agg(F.max("auto").alias("best"))
    return tries.crossJoin(F.broadcast(best)).select("threshold", "auto", "best", (F.col("best").isNull() | (F.col("auto") + margin >= F.col("best"))).alias("allowed"))  # one row


def best_margin(rows: DataFrame, low: float = 1.0, high: float = 2.5, step: float = 0.05, resamples: int = 200, seed: int = 7) -> DataFrame:
    """(user, margin, sd) of rows (user, positive, grid: array of 0/1 for each margin of the grid: a hit of a positive query, a false
    fire of a control): the middle of the tied best margins by hit rate * (1 - false fire rate), as the median over seeded
    resamples of a user's rows, and their deviation. One small group for each user."""
    grid = np.round(np.arange(low, high + step / 2, step), 2)

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["positive"], kind="stable")
        hit, fire = np.stack(g.loc[g["positive"], "grid"]) if g["positive"].any() else np.zeros((1, len(grid))), np.stack(g.loc[~g["positive"], "grid"]) if (~g["positive"]).any() else np.zeros((1, len(grid)))
        rng, found = np.random.default_rng(seed), []
        for _ in range(resamples):
            auto = hit[rng.integers(0, len(hit), len(hit))].mean(0) * (1 - fire[rng.integers(0, len(fire), len(fire))].mean(0))
            tied = np.flatnonzero(auto >= auto.max() - 1e-12)
            found.append(grid[tied[len(tied) // 2]])
        return pd.DataFrame({"user": [g["user"].iloc[0]], "margin": [float(np.median(found))], "sd": [float(np.std(found))]})

    return rows.groupBy("user").applyInPandas(fit, f"user {rows.schema['user'].dataType.simpleString()}, margin double, sd double")


def novelty(now: DataFrame, before: DataFrame) -> DataFrame:
    """(user, novelty): the share of a user's questions (user, question, answer) that are answered otherwise than before; 1 for a
    user without earlier answers."""
    had = before.select("user").distinct().withColumn("had", F.lit(True))
    d = now.join(before.select("user", "question", F.col("answer").alias("was")), ["user", "question"], "left").join(had, "user", "left")
    return d.groupBy("user").agg(F.when(F.max("had").isNull(), 1.0).otherwise(F.avg((~F.col("answer").eqNullSafe(F.col("was"))).cast("int"))).alias("novelty"))


def filtered_margin(observations: DataFrame, prior: float = 1.35, prior_sd: float = 0.25, drift_sd: float = 0.02, low: float = 1.0, high: float = 2.5) -> DataFrame:
    """(user, x, variance, n) of observations (user, at, z, r, novelty, proxy): a Kalman filter with one number, folded in order of
    time. An observation that brings nothing new is left out, and so is a proxy that argues downward; novelty weighs the rest."""
    steps = F.array_sort(F.collect_list(F.struct("at", "z", "r", "novelty", "proxy")))
    start = F.struct(F.lit(prior).alias("x"), F.lit(prior_sd**2).alias("p"), F.lit(0).alias("n"))

    def step(s: Column, o: Column) -> Column:
        p = s["p"] + drift_sd**2 * o["novelty"]
        gain = p / (p + o["r"] / o["novelty"])
        moved = F.greatest(F.lit(low), F.least(F.lit(high), s["x"] + gain * (o["z"] - s["x"])))
        skip = (o["novelty"] <= 0) | (o["proxy"] & (o["z"] < s["x"]))
        return F.when(skip, s).otherwise(F.struct(moved.alias("x"), ((1 - gain) * p).alias("p"), (s["n"] + 1).alias("n")))

    return observations.groupBy("user").agg(F.aggregate(steps, start, step).alias("s")).select("user", F.round("s.x", 6).alias("x"), F.round("s.p", 9).alias("variance"), F.col("s.n").alias("n"))


def short_band(prompts: DataFrame, least: int = 12, share: float = 0.3) -> DataFrame:
    """(qid, text): distinct one-line prompts from 12 characters up to the length at that share of all one-line prompts."""
    one = prompts.where(~F.contains("text", F.lit("\n"))).withColumn("n", F.length("text")).where(F.col("n") >= least)
    by = one.groupBy("n").agg(F.count(F.lit(1)).alias("c"))
    at = by.select("n", F.sum("c").over(Window.orderBy("n")).alias("upto"), F.sum("c").over(Window.partitionBy(F.lit(0))).alias("total"))  # one row for each length
    limit = at.where(F.col("upto") > F.floor(F.col("total") * share)).agg(F.min("n").alias("limit"))
    return one.crossJoin(F.broadcast(limit)).where("n <= limit").groupBy("text").agg(F.min("qid").alias("qid")).select("qid", "text")  # one row


def draft(band: DataFrame, results: DataFrame, threshold: float, most: int = 3) -> DataFrame:
    """(qid, text, part, candidates): prompts for an evaluation set with their first candidates; A (memory needed) where the first
    score reaches the threshold, else C."""
    some = results.where(F.col("rank") <= most).groupBy("qid").agg(F.max("score").alias("top"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias("candidates"))
    return band.join(some, "qid", "left").select("qid", "text", F.when(F.col("top") >= threshold, "A").otherwise("C").alias("part"), "candidates")


def axes(results: DataFrame, gold: DataFrame, attached: DataFrame, controls: DataFrame, grepped: DataFrame, mentioned: DataFrame, n_docs: int) -> DataFrame:
    """(way, recall_3, attach, specificity, read): three ways against each other. search: gold in the first three, gold attached,
    controls left alone, three files read; grep (qid, files): a right file in three at random, no control without a file,
    and the share of documents that it reads; mention (qid): queries whose gold an index names."""
    asked = gold.select("qid").distinct()
    rank = asked.join(results.join(gold, ["qid", "doc_id"]).groupBy("qid").agg(F.min("rank").alias("rank")), "qid", "left")
    put = asked.join(attached.join(gold, ["qid", "doc_id"], "left_semi").select("qid", F.lit(1).alias("put")).distinct(), "qid", "left")
    quiet = controls.join(attached.select("qid", F.lit(1).alias("put")).distinct(), "qid", "left").agg(F.round(F.avg(F.when(F.col("put").isNull(), 1.0).otherwise(0.0)), 6).alias("specificity"))
    a = rank.agg(F.round(F.avg(F.coalesce((F.col("rank") <= 3).cast("double"), F.lit(0.0))), 6).alias("recall_3")).crossJoin(put.agg(F.round(F.avg(F.coalesce("put", F.lit(0))), 6).alias("attach"))).crossJoin(quiet)  # one row each
    a = a.select(F.lit("search").alias("way"), "recall_3", "attach", "specificity", F.round(F.lit(3.0 / max(n_docs, 1)), 6).alias("read"))
    g = grepped.join(asked.withColumn("pos", F.lit(True)), "qid", "left").withColumn("hit", F.least(F.lit(1.0), F.try_divide(F.lit(3.0), F.col("files"))))
    g = g.agg(F.round(F.avg(F.when(F.col("pos"), F.coalesce("hit", F.lit(0.0)))), 6).alias("recall_3"), F.round(F.avg(F.when(F.col("pos"), (F.col("files") > 0).cast("int"))), 6).alias("attach"), F.round(F.avg(F.when(F.col("pos").isNull(), (F.col("files") == 0).cast("int"))), 6).alias("specificity"), F.round(F.avg(F.col("files") / max(n_docs, 1)), 6).alias("read"))
    m = asked.join(mentioned.select("qid", F.lit(1).alias("m")).distinct(), "qid", "left").agg(F.round(F.avg(F.coalesce("m", F.lit(0))), 6).alias("recall_3"))
    none = F.lit(None).cast("double")
    return a.unionByName(g.select(F.lit("grep").alias("way"), "recall_3", "attach", "specificity", "read")).unionByName(m.select(F.lit("mention").alias("way"), "recall_3", none.alias("attach"), none.alias("specificity"), none.alias("read")))


def alike_pairs(x: DataFrame, y: DataFrame, least: float) -> DataFrame:
    """(a, b, ratio): keys of two tables (key, t) of distinct texts that are alike by ``least`` or more, each pair compared once.

    Prose of one alphabet shares most of its letters, so no key tells which texts are far from each other: all meet. Blocks of
    texts of both tables meet in one task each, so memory is bounded and work is dealt evenly; a pair is given up as soon as
    its matching runs can't reach ``least``, and only pairs that do are rows. Work grows with the product of both tables."""
    n, m = (1 + d.count() // ALIKE_BLOCK for d in (x, y))
    block = lambda k: F.pmod(F.xxhash64("key"), F.lit(k).cast("long"))
    every = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")))
    met = lambda d: d.repartition(min(n * m, 2000), "block", "part").groupBy("block", "part")

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        letters = Letters([*left["t"], *right["t"]])
        counted = [(k, t, letters.counts(t)) for k, t in zip(left["key"], left["t"])]
        out = []
        for key, t in zip(right["key"], right["t"]):
            runs = Runs(t, letters)
            out += [(k, key, r) for k, o, c in counted if (r := runs.ratio(o, c, least)) is not None]
        return pd.DataFrame(out, columns=["a", "b", "ratio"])

    one, other = x.select("key", "t", block(n).alias("block"), every(m).alias("part")), y.select("key", "t", block(m).alias("part"), every(n).alias("block"))
    return met(one).cogroup(met(other)).applyInPandas(meet, "a string, b string, ratio double")


def label_conflicts(needed: DataFrame, controls: DataFrame, gold: DataFrame, conflict: float = 0.55, warning: float = 0.45) -> DataFrame:
    """(qid, other, issue): needed and control queries (qid, text) that are nearly alike by their letters and digits, and needed
    queries without gold (qid). A null text is empty; two without letters are alike."""
    flat = lambda d: d.select("qid", F.regexp_replace(F.coalesce("text", F.lit("")), "[^가-힣a-zA-Z0-9]", "").alias("t")).withColumn("key", F.md5("t"))
    x, y = flat(needed), flat(controls)
    found = alike_pairs(x.select("key", "t").distinct(), y.select("key", "t").distinct(), warning)
    pairs = found.join(x.select("qid", F.col("key").alias("a")), "a").join(y.select(F.col("qid").cast("string").alias("other"), F.col("key").alias("b")), "b")
    pairs = pairs.select("qid", "other", F.when(F.col("ratio") >= conflict, "conflict").otherwise("warning").alias("issue"))
    lost = needed.join(gold.select("qid").distinct(), "qid", "left_anti").select("qid", F.lit(None).cast("string").alias("other"), F.lit("no-gold").alias("issue"))
    return pairs.unionByName(lost)


def contaminated(controls: DataFrame, docs: DataFrame, terms: DataFrame, posted: DataFrame, quote: int = 12) -> DataFrame:
    """(qid, doc_id): controls of 12 characters or more that stand in a document as they are."""
    return containment_gold(controls.where(F.length("text") >= quote), docs, terms, posted)


def self_reach(results: DataFrame, docs: DataFrame) -> DataFrame:
    """One row (asked, first, in_five) of results of asking each document's own description (qid is the doc_id)."""
    mine = results.where("qid = doc_id").select("qid", "rank")
    d = docs.select(F.col("doc_id").alias("qid")).join(mine, "qid", "left")
    share = lambda k: F.round(F.avg(F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0))), 6)
    return d.agg(F.count(F.lit(1)).alias("asked"), share(1).alias("first"), share(5).alias("in_five"))


def miss_causes(results: DataFrame, gold: DataFrame, queries: DataFrame, posted: DataFrame, few: int = 2) -> DataFrame:
    """(cause, n): gold documents that the ranking lacks, by whether they share more than so many words with the query."""
    lost = gold.join(results.select("qid", "doc_id"), ["qid", "doc_id"], "left_anti")
    words = queries.select("qid", F.explode(T.query_words(T.words(F.col("text")))).alias("term")).distinct()
    shared = lost.join(words, "qid").join(posted.select("doc_id", "term"), ["doc_id", "term"]).groupBy("qid", "doc_id").agg(F.count(F.lit(1)).alias("shared"))
    d = lost.join(shared, ["qid", "doc_id"], "left").withColumn("cause", F.when(F.coalesce("shared", F.lit(0)) <= few, "few-words").otherwise("outranked"))
    return d.groupBy("cause").agg(F.count(F.lit(1)).alias("n"))


def context_cost(docs: DataFrame, per_hangul: float = 0.9, per_other: float = 0.25) -> DataFrame:
    """One row (documents, median_chars, mean_chars, hangul_share, tokens) of docs (body): size, script mix, and the tokens that the
    mix makes of all characters."""
    n, h = F.length("body"), F.length(F.regexp_replace("body", "[^가-힣]", ""))
    a = docs.select(n.alias("n"), h.alias("h")).agg(F.count(F.lit(1)).alias("documents"), F.percentile("n", F.lit(0.5)).alias("median_chars"), F.round(F.avg("n"), 6).alias("mean_chars"), F.sum("n").alias("chars"), F.sum("h").alias("hangul"))
    return a.select("documents", "median_chars", "mean_chars", F.round(F.try_divide(F.col("hangul"), F.col("chars")), 6).alias("hangul_share"), F.round(F.col("hangul") * per_hangul + (F.col("chars") - F.col("hangul")) * per_other, 3).alias("tokens"))


def graded(log: DataFrame) -> DataFrame:
    """log (.., answer, expected, obsolete) with ``state``: correct (the answer's JSON has all expected fields and no obsolete value),
    wrong, or failed (no JSON)."""
    got = F.from_json("answer", "map<string,string>")
    right = F.forall(F.map_entries("expected"), lambda e: F.coalesce(got[e["key"]] == e["value"], F.lit(False)))
    old = F.coalesce(F.arrays_overlap(F.map_values(got), F.col("obsolete")), F.lit(False))
    return log.withColumn("state", F.when(got.isNull(), "failed").when(right & ~old, "correct").otherwise("wrong"))


def trial_summary(log: DataFrame) -> DataFrame:
    """(host, arm, attempted, correct, failed, p50, p95) of graded trials (host, arm, secs, state); nearest-rank percentiles."""
    at = lambda q: F.percentile_approx("secs", F.lit(q), F.lit(1_000_000))
    return log.groupBy("host", "arm").agg(F.count(F.lit(1)).alias("attempted"), F.count(F.when(F.col("state") == "correct", 1)).alias("correct"), F.count(F.when(F.col("state") == "failed", 1)).alias("failed"), at(0.5).alias("p50"), at(0.95).alias("p95"))


def trial_pairs(log: DataFrame, arm: str, against: str) -> DataFrame:
    """(host, wins, losses, ties, incomplete) of two arms over the same (case, repeat)."""
    side = lambda a, c: log.where(F.col("arm") == a).groupBy("host", "case", "repeat").agg(F.max((F.col("state") == "correct").cast("int")).alias(c))
    d = side(arm, "x").join(side(against, "y"), ["host", "case", "repeat"], "full_outer")
    n = lambda c: F.count(F.when(c, 1))
    return d.groupBy("host").agg(n(F.col("x") > F.col("y")).alias("wins"), n(F.col("x") < F.col("y")).alias("losses"), n(F.col("x") == F.col("y")).alias("ties"), n(F.col("x").isNull() | F.col("y").isNull()).alias("incomplete"))


def judge_stability(runs: DataFrame, floor: float) -> DataFrame:
    """One row (controls, fired, queries, same) of judged runs (qid, control, repeat, score): controls that reach the floor in any
    run, and other queries with one decision in all runs."""
    q = runs.groupBy("qid", "control").agg(F.max((F.col("score") >= floor).cast("int")).alias("high"), F.min((F.col("score") >= floor).cast("int")).alias("low"))
    c = F.col("control")
    return q.agg(F.count(F.when(c, 1)).alias("controls"), F.count(F.when(c & (F.col("high") == 1), 1)).alias("fired"), F.count(F.when(~c, 1)).alias("queries"), F.count(F.when(~c & (F.col("high") == F.col("low")), 1)).alias("same"))


def scorecard(axes: DataFrame, weights: dict[str, float], targets: dict[str, float]) -> DataFrame:
    """One row: the weighted mean of min(100, 100 * raw / target) over the axes that were measured."""
    of = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])[F.col("axis")]
    s = axes.where("raw is not null").select("axis", F.least(F.lit(100.0), F.col("raw") * 100.0 / of(targets)).alias("score"), of(weights).alias("w"))
    return s.agg(F.round(F.try_divide(F.sum(F.col("score") * F.col("w")), F.sum("w")), 6).alias("total"), F.count(F.lit(1)).alias("measured"))


def moved_only(history: DataFrame) -> DataFrame:
    """Rows (key, at, value) at which the value moved."""
    by = Window.partitionBy("key").orderBy("at")
    return history.withColumn("_was", F.lag("value").over(by)).where("_was is null or _was <> value").drop("_was")
