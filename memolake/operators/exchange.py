"""Moving tables between machines and stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_refs(changes: DataFrame, most: int = 4) -> DataFrame:
    """(key, refs): the newest changes (key, at, ref) of each key, in order."""
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("at"), "ref"))
    few = changes.withColumn("place", place).where(F.col("place") <= most)
    return few.groupBy("key").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("place", F.col("ref").cast("string").alias("ref")))), lambda x: x["ref"])).alias("refs"))


def file_keys(path: Column) -> Column:
    """What a file is looked up by: its last two parts, and its name."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    name = F.try_element_at(parts, F.lit(-1))
    return F.array_distinct(F.array_compact(F.array(F.when(F.size(parts) > 1, F.array_join(F.slice(parts, -2, 2), "/")), name)))


def commit_pointers(commits: DataFrame, extensions: list[str], most: int = 4) -> DataFrame:
    """(key, refs): for each key of a changed file with one of the extensions, its newest commits (sha, at, files), the first
    few."""
    files = commits.select("sha", "at", F.explode("files").alias("file")).where(F.lower(F.regexp_extract("file", r"\.([^./]+)$", 1)).isin(extensions))
    keyed = files.select(F.explode(file_keys(F.col("file"))).alias("key"), "at", F.col("sha").alias("ref")).distinct()
    return first_refs(keyed, most)


def history_of(paths: DataFrame, pointers: DataFrame) -> DataFrame:
    """(path, refs): the pointers of a path's last two parts, else those of its name."""
    keys = paths.select("path", F.posexplode(file_keys(F.col("path"))).alias("place", "key"))
    hit = keys.join(pointers, "key").groupBy("path").agg(F.min_by("refs", "place").alias("refs"))
    return hit


def merged_vectors(mine: DataFrame, theirs: DataFrame, current: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vectors, refused) of two machines' vectors (name, chunk_no, sha, vec): theirs come in where they are of the content that
    a document (name, sha) has now and mine has none for the same name, chunk and content; the others of an older content
    are counted, one row (n)."""
    fresh = theirs.join(current.select("name", "sha"), ["name", "sha"], "left_semi")
    new = fresh.join(mine.select("name", "chunk_no", "sha"), ["name", "chunk_no", "sha"], "left_anti")
    return mine.unionByName(new.select(*mine.columns)), theirs.join(current.select("name", "sha"), ["name", "sha"], "left_anti").agg(F.count(F.lit(1)).alias("n"))


def set_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """The rows that only one of two tables has, with ``only`` (a or b); none if they agree, repeated rows counted."""
    return a.exceptAll(b.select(*a.columns)).withColumn("only", F.lit("a")).union(b.select(*a.columns).exceptAll(a).withColumn("only", F.lit("b")))


def merged_counters(mine: DataFrame, theirs: DataFrame, key: str, counters: list[str]) -> DataFrame:
    """Counters of two machines by the larger number."""
    other = theirs.select(key, *[F.col(c).alias(f"_{c}") for c in counters])
    return mine.join(other, key, "full_outer").select(key, *[F.greatest(F.coalesce(c, F.lit(0)), F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in counters])


def changed_set(desired: DataFrame, ledger: DataFrame, held: int | None = None) -> DataFrame:
    """(key, action) of desired and held (key, digest): upsert, delete or keep. held: how many rows the copy says it has; where
    the ledger has another number, all that is desired is sent again."""
    if held is not None and held != ledger.count():
        ledger = ledger.join(desired.select("key"), "key", "left_anti")
    both = desired.join(ledger.select("key", F.col("digest").alias("held")), "key", "full_outer")
    action = F.when(F.col("digest").isNull(), "delete").when(F.col("held").eqNullSafe(F.col("digest")), "keep").otherwise("upsert")
    return both.select("key", action.alias("action"))


def agreement(a: DataFrame, b: DataFrame, k: int = 10) -> DataFrame:
    """(qid, same_first, overlap, max_delta) of two result tables (qid, doc_id, rank, score)."""
    of = lambda d, s: d.where(F.col("rank") <= k).select("qid", "doc_id", F.col("rank").alias(f"rank_{s}"), F.col("score").alias(f"score_{s}"))
    both = of(a, "a").join(of(b, "b"), ["qid", "doc_id"], "full_outer")
    out = both.groupBy("qid").agg(
        F.max(F.when((F.col("rank_a") == 1) & (F.col("rank_b") == 1), 1).otherwise(0)).alias("same_first"),
        F.count(F.when(F.col("rank_a").isNotNull() & F.col("rank_b").isNotNull(), 1)).alias("overlap"), F.round(F.max(F.abs(F.col("score_a") - F.col("score_b"))), 6).alias("max_delta"),
    )
    return out
