"""Facts in time: revisions, resolution as of a moment, versions, writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memolake.tables import released, staged

# States that a record can declare.
STATES = ["active", "proposed", "disputed", "superseded", "retracted", "archived"]


#: States of a record that takes the place of the one before.
FOLLOWING = ["active", "superseded", "retracted", "archived", "disputed"]


def issues(r: DataFrame) -> DataFrame:
    """Records with the array of what is wrong with them: state, order of times, a replacement without start or reason."""
    found = F.array_compact(F.array(
        F.when(~F.col("status").isin(STATES), F.lit("status")), F.when(F.col("valid_to") <= F.col("valid_from"), F.lit("time_order")),
        F.when(F.col("replaces").isNotNull() & F.col("valid_from").isNull(), F.lit("no_start")), F.when(F.col("replaces").isNotNull() & F.col("reason").isNull(), F.lit("no_reason")),
    ))
    return r.withColumn("issues", found)


def identity_collisions(r: DataFrame) -> DataFrame:
    """(scope, topic, facet, n): facts that several current records of a scope state."""
    return r.groupBy("scope", "topic", "facet").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def started(as_of: Column) -> Column:
    return F.coalesce(F.col("valid_from") <= as_of, F.lit(True))


def eligible(as_of: Column) -> Column:
    """Active and inside its half-open interval."""
    return (F.col("status") == "active") & started(as_of) & F.coalesce(as_of < F.col("valid_to"), F.lit(True))


def resolved(records: DataFrame, successors: DataFrame, as_of: Column) -> DataFrame:
    """(id, current): the eligible ends that each record leads to by started successors that aren't proposed. Where records
    have a column ``issue``, those with one neither follow nor are ends.

    Pointer doubling: each round, a table, goes from where a record leads on to where that leads; ends stay. A record has
    one row where it and those after it have one successor, several only where they branch. The shortest way to an end
    passes each record once, so once the steps are as many as the records that have one, what still moves is in cycles
    and reaches no further end.
    """
    clear = F.col("issue").isNull() if "issue" in records.columns else F.lit(True)
    can = records.where(started(as_of) & F.col("status").isin(FOLLOWING) & clear).select(F.col("id").alias("next"))
    step = staged(successors.join(can, "next", "left_semi").select("id", "next").distinct(), "step")
    moving = step.select(F.col("id").alias("_id")).distinct()
    most, steps = moving.count(), 1
    reach = staged(step.join(moving, step["next"] == moving["_id"], "left").select(F.col("id").alias("origin"), F.col("next").alias("at"), F.col("_id").isNull().alias("end")), "reach")
    while steps < most and reach.where("not end").limit(1).count():
        on = reach.select(F.col("origin").alias("_by"), F.col("at").alias("_to"), F.col("end").alias("_end"))
        gone = reach.where("not end").join(on, F.col("at") == F.col("_by")).select("origin", F.col("_to").alias("at"), F.col("_end").alias("end"))
        old, reach, steps = reach, staged(reach.where("end").unionByName(gone).distinct(), "reach"), 2 * steps
        released(old)
    own = records.select("id").join(step, "id", "left_anti").select(F.col("id").alias("origin"), F.col("id").alias("at"))
    far = reach.where("end").join(records.select(F.col("id").alias("origin")), "origin", "left_semi").select("origin", "at")
    good = records.where(eligible(as_of) & clear).select(F.col("id").alias("at"))
    return own.unionByName(far).join(good, "at").select(F.col("origin").alias("id"), F.col("at").alias("current"))


def remapped(hits: DataFrame, resolution: DataFrame) -> DataFrame:
    """(qid, doc_id, score, origins): hits on old revisions go to current ones, the best score counts."""
    moved = hits.join(resolution, hits["doc_id"] == resolution["id"]).select("qid", F.col("current").alias("doc_id"), "score", F.col("id").alias("origin"))
    return moved.groupBy("qid", "doc_id").agg(F.max("score").alias("score"), F.concat_ws(",", F.array_sort(F.collect_set("origin"))).alias("origins"))


def versions(observed: DataFrame) -> DataFrame:
    """Observations (key, at, content) at which the content changed, with a running number and a flag for the latest."""
    by = Window.partitionBy("key").orderBy("at", "content")
    sha = F.sha1(F.col("content").cast("string"))
    v = observed.withColumn("sha", sha).withColumn("_was", F.lag("sha").over(by)).where("_was is null or _was <> sha")
    latest = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("at"), F.desc("content"))) == 1
    return v.withColumn("version", F.row_number().over(by)).withColumn("latest", latest).drop("_was")


def quote_check(claims: DataFrame) -> DataFrame:
    """claims (id, body, quote) with start, end and state: ok where the quote stands in the body exactly once."""
    first = F.expr("locate(quote, body)")
    again = F.expr("locate(quote, body, locate(quote, body) + 1)")
    state = F.when(F.col("quote") == "", "empty").when(first == 0, "absent").when(again > 0, "ambiguous").otherwise("ok")
    return claims.select("id", state.alias("state"), F.when(state == "ok", first - 1).alias("start"), F.when(state == "ok", first - 1 + F.length("quote")).alias("end"))


def write_decisions(incoming: DataFrame, current: DataFrame) -> DataFrame:
    """(scope, name, decision): incoming (scope, name, key, payload_sha, expected) against current (scope, name, key,
    payload_sha, sha): new, noop, updated, sha_mismatch or name_taken."""
    i, c = incoming.alias("i"), current.alias("c")
    both = i.join(c, (F.col("i.scope") == F.col("c.scope")) & (F.col("i.name") == F.col("c.name")), "left")
    absent, same_key = F.col("c.name").isNull(), F.col("i.key") == F.col("c.key")
    decision = (
        F.when(absent & F.col("i.expected").isNull(), "new").when(absent, "sha_mismatch").when(~same_key, "name_taken")
        .when(F.col("i.payload_sha") == F.col("c.payload_sha"), "noop").when(F.col("i.expected") == F.col("c.sha"), "updated").otherwise("sha_mismatch")
    )
    return both.select("i.scope", "i.name", decision.alias("decision"))
