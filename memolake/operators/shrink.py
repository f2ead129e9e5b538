"""What to take out of index files that have grown over their target size, while every fact stays in its source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A line that points to a file and why one would open it; where a clause ends; sections that stay as they are.
POINTER = r"^([-*] \[[^\]]+\]\([A-Za-z0-9_./-]+\.md\))\s*(?:[—–-]\s*)?(.*)$"
CLAUSE_ENDS = r"(?<=[.!?。])\s| · |; | — | → "
KEPT_ROLES = ["directives", "signals"]
HOOK, RECENT = 80, 7


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def first_clause(hook: Column, most: int = HOOK) -> Column:
    """A hook's first clause, of at most so many characters, without a piece of code that isn't closed."""
    clause = stripped(F.element_at(F.split(stripped(hook), CLAUSE_ENDS, 2), 1))
    short = F.when(F.length(clause) > most, F.concat(F.regexp_replace(F.substring(clause, 1, most - 1), r"\s+$", ""), F.lit("…"))).otherwise(clause)
    before = F.regexp_replace(F.regexp_replace(short, "`[^`]*$", ""), r"\s+$", "")
    return F.when(F.size(F.split(short, "`")) % 2 == 1, short).when(before == "", before).otherwise(F.concat(before, F.lit("…")))


def shortened(line: Column, most: int = HOOK) -> Column:
    """The pointer with the first clause of its hook; null for other lines, and where that isn't shorter."""
    clause = first_clause(F.regexp_extract(line, POINTER, 2), most)
    new = F.concat(F.regexp_extract(line, POINTER, 1), F.when(clause == "", "").otherwise(F.concat(F.lit(" — "), clause)))
    return F.when(line.rlike(POINTER) & ~F.contains(line, F.lit("\n")) & (F.length(new) < F.length(line)), new)


def eligible(items: DataFrame, verdicts: DataFrame, sources: DataFrame, missing: DataFrame, limits: DataFrame, recent: int = RECENT) -> DataFrame:
    """items (path, line, role, raw, golds) with ``skipped``, null for those that may be touched, ``age`` (days of the newest
    source) and ``stale`` (all sources are older than their kind's limit).

    verdicts (path, line, verdict), sources (name, kind, age_days), missing (path, line): items with a fact that no source has,
    limits (kind, days); of a kind without a limit nothing is stale."""
    known = sources.join(limits, "kind", "left").groupBy("name").agg(F.min("age_days").alias("age"), F.min(F.coalesce(F.col("age_days") >= F.col("days"), F.lit(False))).alias("stale"))
    each = items.select("path", "line", F.explode(F.array_distinct("golds")).alias("name")).join(known, "name", "left").groupBy("path", "line")
    each = each.agg(F.max(F.col("age").isNull()).alias("lost"), F.min("age").alias("age"), F.min(F.coalesce("stale", F.lit(False))).alias("stale"))
    only = missing.select("path", "line").distinct().withColumn("only_here", F.lit(True))
    d = items.join(verdicts.select("path", "line", "verdict"), ["path", "line"], "left").join(each, ["path", "line"], "left").join(only, ["path", "line"], "left")
    skipped = (
        F.when(F.coalesce("verdict", F.lit("")) != "safe", F.coalesce("verdict", F.lit("unknown"))).when(F.col("role").isin(KEPT_ROLES), "section").when(F.coalesce("lost", F.lit(True)), "no-source")
        .when(F.col("only_here"), "fact-only-here").when(F.col("age") < recent, "recent")
    )
    return d.select(*items.columns, skipped.alias("skipped"), "age", F.coalesce("stale", F.lit(False)).alias("stale"))


def shrink_plan(files: DataFrame, touchable: DataFrame, most: int = HOOK) -> DataFrame:
    """(path, line, action, new, saved): what brings each file (path, chars, target) down to its target, or as near as it goes.

    touchable: as from ``eligible``. First pointer lines are shortened in the order of the file, then stale items dropped, the
    oldest first, each only while the file is still over its target: what was saved before an item decides. Files at or under
    their target, or without one (0), are left alone; ties go to the earlier line."""
    d = touchable.where("skipped is null").join(files.where("target > 0 and chars > target"), "path").withColumn("short", shortened(F.col("raw"), most))
    over = F.col("chars") - F.col("target")
    gain = F.coalesce(F.length("raw") - F.length("short"), F.lit(0))
    running = lambda c, *order: F.coalesce(F.sum(c).over(Window.partitionBy("path").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    d = d.withColumn("_gain", gain).withColumn("cut", F.col("short").isNotNull() & (running("_gain", "line") < over))
    d = d.withColumn("_cut", F.when(F.col("cut"), F.col("_gain")).otherwise(0)).withColumn("_first", F.sum("_cut").over(Window.partitionBy("path")))
    d = d.withColumn("_drop", F.when(F.col("stale"), F.length("raw") - F.col("_cut") + 1).otherwise(0))
    d = d.withColumn("drop", F.col("stale") & (F.col("_first") + running("_drop", F.desc("stale"), F.desc("age"), "line") < over)).where("cut or drop")
    saved = F.col("_cut") + F.when(F.col("drop"), F.col("_drop")).otherwise(0)
    return d.select("path", "line", F.when(F.col("drop"), "drop").otherwise("shorten").alias("action"), F.when(~F.col("drop"), F.col("short")).alias("new"), saved.cast("long").alias("saved"))
