"""Where requests of a log end, and what they counted on the way: one pass of tallies, and each request folded once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memolake.operators.usage import ranked_value

#: The columns of a request's row, all but request and ts nullable.
REQUEST = """request long, ts timestamp, excluded string, hit boolean, stage string, cut boolean, attached map<string,int>, reindex struct<ran: boolean, secs: double, deferred: boolean>,
judge struct<phase: string, outcome: string, decision: string, sent: boolean, returned: boolean, valid: boolean, cached: boolean, secs: double, kind: string, top: double, vector: struct<by: string, why: string, embedded: boolean>>"""
# What documents were attached by, and decisions that end a judgement.
SOURCES, DECIDED = ["lexical", "trigger", "semantic", "graph"], ["below", "fired"]
#: How far a request came; of two rows of one the farther counts, of equals the later.
STATES = ["silent", "silent-reindex", "excluded", "cut", "below", "attached"]


def yes(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(False))


def tally(section: str, key: str | Column, when: Column, n: Column | None = None) -> Column:
    """A counted entry where the condition holds, else null."""
    return F.when(when, F.struct(F.lit(section).alias("section"), (F.lit(key) if isinstance(key, str) else key).alias("key"), (F.lit(1) if n is None else n).cast("long").alias("n")))


def each(section: str, key: Column, when: Column) -> Column:
    return tally(section, key.cast("string"), when & key.isNotNull())


def request_tallies(log: DataFrame) -> DataFrame:
    """(day, section, key, n) of a log of REQUEST rows: those left out and why, searched ones, what was attached by what, where
    they were cut, refreshes, and how far the judgement went. A null counts as no; sums of 0 have no row. A row that is
    repeated counts again: this tells of rows, ``request_ends`` of requests."""
    j, judged = (lambda f: F.col(f"judge.{f}")), F.col("judge").isNotNull()
    searched = F.col("excluded").isNull()
    seen, cut = judged & searched, yes("cut") & searched
    by = F.coalesce("attached", F.create_map().cast("map<string,int>"))
    found = [
        tally("request", "rows", F.lit(True)), each("excluded", F.col("excluded"), ~searched), tally("request", "searched", searched), tally("request", "attached_any", searched & yes("hit")),
        tally("request", "silent_reindex", searched & (F.coalesce("stage", F.lit("")) == "index") & ~yes("cut") & ~yes("hit")), tally("request", "cut", cut), each("cut_at", F.coalesce(j("phase"), F.col("stage")), cut),
        tally("reindex", "ran", searched & yes("reindex.ran")), tally("reindex", "deferred", searched & yes("reindex.ran") & yes("reindex.deferred")),
        *[tally("source", s, searched & (F.coalesce(F.try_element_at(by, F.lit(s)), F.lit(0)) != 0), F.try_element_at(by, F.lit(s))) for s in SOURCES],
        tally("judge", "reached", seen), tally("judge", "finished", seen & yes(j("decision").isin(DECIDED))), each("outcome", j("outcome"), seen), each("kind", j("kind"), seen & (j("kind") != "")),
        *[tally("judge", x, seen & yes(j(x))) for x in ("sent", "returned", "valid")], tally("judge", "cut_out", seen & yes(j("sent")) & ~yes(j("returned"))),
        each("top", j("top").cast("int"), seen & yes(j("valid"))), each("vector", j("vector.by"), seen), tally("vector", "embedded", seen & yes(j("vector.embedded"))), each("local_why", j("vector.why"), seen & (j("vector.by") == "local") & (j("vector.why") != "")),
    ]
    rows = log.select(F.to_date("ts").alias("day"), F.explode(F.array_compact(F.array(*found))).alias("x"))
    return rows.groupBy("day", "x.section", "x.key").agg(F.sum("x.n").alias("n"))


def request_times(log: DataFrame, q: float) -> DataFrame:
    """(day, what, secs): of refreshes, and of judgements that came back fresh, the value at place floor(q * n) in order."""
    searched = log.where("excluded is null")
    reindex = searched.where(yes("reindex.ran")).select(F.to_date("ts").alias("day"), F.lit("reindex").alias("what"), F.col("reindex.secs").alias("secs"))
    fresh = searched.where(yes("judge.returned") & ~yes("judge.cached")).select(F.to_date("ts").alias("day"), F.lit("judge").alias("what"), F.col("judge.secs").alias("secs"))
    return ranked_value(reindex.union(fresh), ["day", "what"], "secs", q)


def request_ends(log: DataFrame) -> DataFrame:
    """(request, state, at): the one state in which each request ended: attached, below (judged and found too little), cut,
    excluded, silent after a refresh, or silent. A request may have several rows, in any order, late or repeated: the one that
    came farthest counts, of equals the latest."""
    state = (
        F.when(F.col("excluded").isNotNull(), "excluded").when(yes("hit"), "attached").when(yes("cut"), "cut").when(yes(F.col("judge.decision").isin(DECIDED)), "below")
        .when(F.coalesce("stage", F.lit("")) == "index", "silent-reindex").otherwise("silent")
    )
    far = F.array_position(F.array(*map(F.lit, STATES)), state)
    last = log.groupBy("request").agg(F.max(F.struct(far.alias("far"), "ts")).alias("e"))
    return last.select("request", F.element_at(F.array(*map(F.lit, STATES)), F.col("e.far").cast("int")).alias("state"), F.col("e.ts").alias("at"))


def recall_tallies(calls: DataFrame) -> DataFrame:
    """(day, key, n) of recall calls (ts, semantic_k, auto, unsure, bridged, reordered, meaning, meaning_fail, vector_by, graph_by)."""
    some = lambda c: F.coalesce(F.col(c), F.lit(0)) > 0
    keys = [
        F.lit("calls"), F.when(some("semantic_k"), "semantic_asked"), *[F.when(yes(x), x) for x in ("auto", "unsure", "reordered")], F.when(some("bridged"), "bridged"), F.when(some("meaning"), "meaning_returned"),
        *[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{p}:"), F.col(c))) for p, c in (("meaning_fail", "meaning_fail"), ("vector", "vector_by"), ("graph", "graph_by"))],
    ]
    return calls.select(F.to_date("ts").alias("day"), F.explode(F.array_compact(F.array(*keys))).alias("key")).groupBy("day", "key").agg(F.count(F.lit(1)).alias("n"))
