"""What the logs of use tell: weights, summaries, sessions, trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memolake.functions import text as T

# What a signal adds to a document's weight, and the weight's bounds.
SIGNALS = {"useful": 0.15, "wrong": -0.5, "stale": -0.2, "open": 0.05}
LEAST, MOST = 0.2, 3.0


def feedback_weights(signals: DataFrame, block: int = 4096) -> DataFrame:
    """(path, weight, n) of signals (path, ts, id, signal): from 1.0 on, clamped after every one in time order.

    Steps are folded in blocks: adding d and clamping makes of w the number min(high, max(low, w + add)), and such maps
    follow each other as one. A path with many signals is cut by time into blocks of about that many; only their maps meet.
    """
    delta = F.create_map(*[F.lit(x) for kv in SIGNALS.items() for x in kv])[F.col("signal")]
    d = signals.where(F.col("signal").isin(*SIGNALS)).select("path", "ts", "id", delta.alias("d"))
    # Blocks of equal spans of time, as many as a path's signals ask for.
    of = d.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    number = lambda c: F.col(c).cast("timestamp").cast("double") if dict(signals.dtypes)["ts"].startswith("timestamp") else F.col(c).cast("double")
    span = (number("ts") - number("first")) / F.greatest(number("last") - number("first"), F.lit(1e-9))
    d = d.join(of, "path").withColumn("block", F.floor(span * F.ceil(F.col("n") / block)))
    clamp = lambda x: F.greatest(F.lit(LEAST), F.least(F.lit(MOST), x))
    step = lambda m, x: F.struct((m["add"] + x["d"]).alias("add"), clamp(m["low"] + x["d"]).alias("low"), clamp(m["high"] + x["d"]).alias("high"))
    start = F.struct(F.lit(0.0).alias("add"), F.lit(LEAST).alias("low"), F.lit(MOST).alias("high"))
    maps = d.groupBy("path", "block").agg(F.aggregate(F.array_sort(F.collect_list(F.struct("ts", "id", "d"))), start, step).alias("m"), F.count(F.lit(1)).alias("n"))
    fold = F.aggregate(F.array_sort(F.collect_list(F.struct("block", "m"))), F.lit(1.0), lambda w, x: F.greatest(x["m"]["low"], F.least(x["m"]["high"], w + x["m"]["add"])))
    return maps.groupBy("path").agg(F.round(fold, 6).alias("weight"), F.sum("n").alias("n"))


def ranked_value(df: DataFrame, by: list[str], value: str, q: float) -> DataFrame:
    """(by.., value): the value at place floor(q * n), counted from 0, the last one at most. Equal values are counted first,
    so what is put in order are the distinct values of each group."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    place = F.least(F.col("_n") - 1, F.floor(F.col("_n") * F.lit(q)))
    # First bands of values, by their sign and logarithm, then the values of the one band that holds the place.
    number = F.col(value).cast("double")
    lead = F.when(number < 0, F.floor(-F.log(-number) * 16)).when(number > 0, F.floor(F.log(number) * 16)).otherwise(F.lit(0))
    c = counts.withColumn("_band", F.struct(F.signum(number).alias("side"), lead.alias("lead")))
    bands = c.groupBy(*by, "_band").agg(F.sum("_c").alias("_b"))
    upto = F.sum("_b").over(Window.partitionBy(*by).orderBy("_band"))
    total = F.sum("_b").over(Window.partitionBy(*by))
    bands = bands.withColumn("_upto", upto).withColumn("_n", total).withColumn("_place", place).where((F.col("_upto") > F.col("_place")) & (F.col("_upto") - F.col("_b") <= F.col("_place")))
    within = c.join(bands.select(*by, "_band", "_place", (F.col("_upto") - F.col("_b")).alias("_before")), [*by, "_band"])
    at = F.sum("_c").over(Window.partitionBy(*by).orderBy(value)) + F.col("_before")
    return within.withColumn("_at", at).where((F.col("_at") > F.col("_place")) & (F.col("_at") - F.col("_c") <= F.col("_place"))).select(*by, value)


def day_summary(log: DataFrame) -> DataFrame:
    """(day, rows, by type.., buyers, purchase_rate): the rate is null without views."""
    kind = lambda t: F.count(F.when(F.col("event_type") == t, 1))
    out = log.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), kind("view").alias("views"), kind("click").alias("clicks"), kind("purchase").alias("purchases"), kind("error").alias("errors"), F.countDistinct(F.when(F.col("event_type") == "purchase", F.col("user_id"))).alias("buyers"))
    return out.withColumn("purchase_rate", F.round(F.try_divide(F.col("purchases"), F.col("views")), 6))


def trend(days: DataFrame, metric: str) -> DataFrame:
    """(day, metric, median, low, high, outside) against all earlier days, where there are two or more."""
    before = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)  # one row a day
    earlier = F.array_sort(F.collect_list(F.col(metric).cast("double")).over(before))
    n = F.size("earlier")
    mid = (F.element_at("earlier", F.floor((n + 1) / 2).cast("int")) + F.element_at("earlier", F.floor(n / 2).cast("int") + 1)) / 2
    r = days.select("day", F.col(metric).cast("double").alias(metric), earlier.alias("earlier")).where(n >= 2)
    r = r.select("day", metric, F.round(mid, 6).alias("median"), F.element_at("earlier", 1).alias("low"), F.element_at("earlier", -1).alias("high"))
    return r.withColumn("outside", (F.col(metric) < F.col("low")) | (F.col(metric) > F.col("high")))


def sessions(log: DataFrame, gap_seconds: int = 3600) -> DataFrame:
    """(user_id, start, end, n): runs of a user's events with no gap over the limit."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    s = log.withColumn("_new", (F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(by)) > gap_seconds * 1_000_000).cast("int"))
    s = s.withColumn("_session", F.sum(F.coalesce("_new", F.lit(0))).over(by))
    return s.groupBy("user_id", "_session").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("n")).drop("_session")


def attributed(log: DataFrame, within: int = 1) -> DataFrame:
    """(user_id, opened, shown, turns_ago): each click with the last view of its user within so many turns before it.
    Turns are a user's events in order."""
    turn = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    t = log.withColumn("turn", turn)
    c = t.where("event_type = 'click'").select("user_id", F.col("event_id").alias("opened"), F.col("turn").alias("ct"))
    v = t.where("event_type = 'view'").select(F.col("user_id").alias("vu"), F.col("event_id").alias("shown"), F.col("turn").alias("vt"))
    near = F.explode(F.sequence(F.lit(0), F.lit(within)))
    c = c.withColumn("turns_ago", near).withColumn("at", F.col("ct") - F.col("turns_ago"))
    hit = c.join(v, (F.col("user_id") == F.col("vu")) & (F.col("at") == F.col("vt")))
    first = F.row_number().over(Window.partitionBy("opened").orderBy("turns_ago", "shown"))
    return hit.withColumn("r", first).where("r = 1").select("user_id", "opened", "shown", "turns_ago")


def since_last(log: DataFrame, reset: Column, counted: Column) -> DataFrame:
    """(user_id, event_id, tail): how many counted events a user has had since the last one that resets."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    t = log.withColumn("_era", F.sum(reset.cast("int")).over(by))
    within = Window.partitionBy("user_id", "_era").orderBy("ts", "event_id")
    return t.select("user_id", "event_id", F.sum(F.when(reset, 0).otherwise(counted.cast("int"))).over(within).alias("tail"))


def fired_once(log: DataFrame, budget: int) -> DataFrame:
    """(user_id, rule, event_id): each rule once per user and day, the first ``budget`` of a day."""
    day = F.to_date("ts")
    first = log.groupBy("user_id", day.alias("day"), F.col("event_type").alias("rule")).agg(F.min(F.struct("ts", "event_id")).alias("f"))
    place = F.row_number().over(Window.partitionBy("user_id", "day").orderBy("f"))
    return first.withColumn("place", place).where(F.col("place") <= budget).select("user_id", "day", "rule", F.col("f.event_id").alias("event_id"))


def repeated_questions(asked: DataFrame, linked: DataFrame | None = None, least: int = 2) -> DataFrame:
    """(question, query, times, askers, days, misses, last) of asked (text, asker, ts, hits): questions, case and blanks folded,
    that were asked again; query is how the first one put it, misses had no hit, last is when it was asked last. With linked
    (text, doc_id), the documents that a question found: also their ids, sorted."""
    fold = lambda c: T.case_folded(F.trim(F.regexp_replace(c, r"\s+", " ")))
    q = asked.select(fold("text").alias("question"), "text", "asker", "ts", F.to_date("ts").alias("day"), "hits").where("question <> ''")
    out = q.groupBy("question").agg(
        F.min_by("text", F.struct("ts", "asker", "text")).alias("query"), F.count(F.lit(1)).alias("times"), F.countDistinct("asker").alias("askers"), F.countDistinct("day").alias("days"),
        F.count(F.when(F.col("hits") == 0, 1)).alias("misses"), F.max("ts").alias("last"),
    ).where(F.col("times") >= least)
    if linked is None:
        return out
    ids = linked.select(fold("text").alias("question"), "doc_id").distinct().join(out.select("question"), "question", "left_semi").groupBy("question").agg(F.array_sort(F.collect_list("doc_id")).alias("documents"))
    return out.join(ids, "question", "left").withColumn("documents", F.coalesce("documents", F.array().cast(ids.schema["documents"].dataType)))


def activity(shown: DataFrame, sectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(per document and day, per sector) of shown (doc_id, ts): how often a document was shown; sectors (doc_id, sector)."""
    days = shown.groupBy("doc_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return days, days.join(sectors, "doc_id").groupBy("sector").agg(F.sum("n").alias("n"), F.countDistinct("doc_id").alias("documents"))


def recall_log(results: DataFrame, queries: DataFrame, names: DataFrame, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """(recalls (qid, hits, top), usage (doc_id, hits)) of results (qid, rank, doc_id): a row for each query, those without a
    result too, with the names of its first hits; and how often each document was a hit."""
    top = results.where(F.col("rank") <= most).join(names.select("doc_id", "name"), "doc_id").groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]).alias("top"))
    hits = results.groupBy("qid").agg(F.count(F.lit(1)).alias("hits"))
    log = queries.select("qid").join(hits, "qid", "left").join(top, "qid", "left")
    log = log.select("qid", F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce("top", F.array().cast("array<string>")).alias("top"))
    return log, results.groupBy("doc_id").agg(F.count(F.lit(1)).alias("hits"))


def stale_evidence(stale: DataFrame, usage: DataFrame) -> DataFrame:
    """(doc_id, kind, age, over, recalled) of stale documents, the one most over its limit first in order of ``over``."""
    hit = usage.where(F.col("hits") > 0).select("doc_id", F.lit(True).alias("hit"))
    return stale.join(hit, "doc_id", "left").select("doc_id", "kind", "age", "over", F.coalesce("hit", F.lit(False)).alias("recalled"))


def suggestions(dangling: DataFrame, stale: DataFrame, twins: DataFrame, usage: DataFrame, recalls: DataFrame, wrong: int = 2, most: int = 10) -> DataFrame:
    """(action, subject, other, weight): reconnect (links to nothing), verify (stale evidence), merge (suspected duplicates), prune
    (documents marked wrong so often), missing (the most frequent queries with one hit or none)."""
    text = lambda c: F.col(c).cast("string")
    row = lambda d, action, subject, other, weight: d.select(F.lit(action).alias("action"), text(subject).alias("subject"), (other if other is not None else F.lit(None)).cast("string").alias("other"), weight.cast("double").alias("weight"))
    asked = recalls.where(F.col("hits") <= 1).groupBy("query").agg(F.count(F.lit(1)).alias("times")).orderBy(F.desc("times"), "query").limit(most)  # a report of the most frequent
    bad = usage.where(F.col("wrong") >= wrong).orderBy(F.desc("wrong"), "doc_id").limit(most)
    parts = [row(dangling, "reconnect", "src_id", F.col("dst_name"), F.lit(1)), row(stale, "verify", "doc_id", None, F.col("over")), row(twins, "merge", "a", F.col("b"), F.col("overlap")), row(bad, "prune", "doc_id", None, F.col("wrong")), row(asked, "missing", "query", None, F.col("times"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def day_metrics(days: DataFrame, ratios: dict[str, tuple[str, str]]) -> DataFrame:
    """days with a ratio of two of its columns for each name, null where the lower one is 0."""
    return days.select("*", *[F.round(F.try_divide(F.col(a), F.when(F.col(b) != 0, F.col(b))), 3).alias(name) for name, (a, b) in ratios.items()])


def day_facts(days: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(day, level, code) for each rule (level, code, condition) that a day meets; one of nothing but the day says so."""
    made = F.array_compact(F.array(*[F.when(F.expr(c), F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"))) for level, code, c in rules]))
    return days.select("day", F.explode(made).alias("f")).select("day", "f.level", "f.code")


def consistent_history(log: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Rows of log (at, total, axes: map) that can be right: axes known and between 0 and 100, the total, to one place, the
    weighted mean of those that were measured."""
    of = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    known = F.map_filter("axes", lambda k, v: v.isNotNull())
    keys = F.map_keys("axes")
    sums = F.aggregate(F.map_entries(known), F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("w")), lambda a, e: F.struct((a["s"] + e["value"] * of[e["key"]]).alias("s"), (a["w"] + of[e["key"]]).alias("w")))
    mean = F.round(F.try_divide(sums["s"], sums["w"]), 1)
    good = (F.size(keys) > 0) & (F.size(F.array_except(keys, F.array(*map(F.lit, weights)))) == 0) & F.forall(F.map_values(known), lambda v: (v >= 0) & (v <= 100)) & F.col("total").eqNullSafe(mean)
    return log.where(good)


def carried(log: DataFrame, axes: list[str], days: int = 7) -> DataFrame:
    """log (key, at, axis..) with each of the axes filled, where it is null, from the newest earlier row of the key that has it, if
    that is at most so many days old."""
    before = Window.partitionBy("key").orderBy(F.unix_seconds("at")).rangeBetween(-days * 86400, 0)
    return log.select(*[F.last(c, ignorenulls=True).over(before).alias(c) if c in axes else F.col(c) for c in log.columns])


def current_analyses(analyses: DataFrame, citations: DataFrame, docs: DataFrame, snapshot: DataFrame) -> DataFrame:
    """(id, current) of analyses (id, snapshot): every cited document (id, doc_id, sha) still has that content; one without
    citations must name the corpus's snapshot (one row, snapshot)."""
    c = citations.join(docs.select("doc_id", F.col("sha").alias("now")), "doc_id", "left")
    held = c.groupBy("id").agg(F.min(F.coalesce(F.col("sha") == F.col("now"), F.lit(False)).cast("int")).alias("held"))
    d = analyses.join(held, "id", "left").crossJoin(F.broadcast(snapshot.select(F.col("snapshot").alias("_now"))))  # one row
    return d.select("id", F.coalesce(F.col("held") == 1, F.col("snapshot") == F.col("_now"), F.lit(False)).alias("current"))


def calls_by_day(log: DataFrame, zone: str = "America/Los_Angeles") -> DataFrame:
    return log.groupBy(F.to_date(F.from_utc_timestamp("ts", zone)).alias("day")).agg(F.count(F.lit(1)).alias("calls"))


def by_month(docs: DataFrame, most: int = 18) -> DataFrame:
    """(month, n): documents (evidence) by month, the last ones; those without a date don't count."""
    return docs.where("evidence is not null").groupBy(F.trunc("evidence", "month").alias("month")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("month")).limit(most)


def top_hits(usage: DataFrame, most: int = 10) -> DataFrame:
    """(doc_id, hits): the documents that were hits most often."""
    return usage.where("hits > 0").orderBy(F.desc("hits"), "doc_id").limit(most).select("doc_id", "hits")


def fired_within(log: DataFrame, budget: int, rates: DataFrame | None = None, rare: float = 1.0) -> DataFrame:
    """(session, rule, call): each rule once in a session, at its first call (session, rule, call); past the budget only rules
    whose measured rate (rule, rate) is under one per cent. Without measured rates there is no budget."""
    first = log.groupBy("session", "rule").agg(F.min("call").alias("call"))
    if rates is None:
        return first
    d = first.join(rates, "rule", "left").withColumn("place", F.row_number().over(Window.partitionBy("session").orderBy("call", "rule")))
    return d.where((F.col("place") <= budget) | (F.col("rate") < rare)).select("session", "rule", "call")
