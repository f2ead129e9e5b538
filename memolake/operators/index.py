"""Inverted index: postings, terms, statistics, upkeep, aliases."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memolake.functions import text as T
from memolake.tables import released, staged

# Weights of a document's fields.
FIELD_WEIGHTS = {"name": 6.0, "title": 4.0, "description": 3.0, "body": 1.0}


def postings(docs: DataFrame, mode: str = "sum", k: float = 1.0, weights: dict = FIELD_WEIGHTS, chars: int = 4_000_000) -> DataFrame:
    """(doc_id, term, tf), one row for each row of docs and term: weight times count per field, or times count / (count + k)
    (``sat``), or times 1 + ln(count) (``log``). Terms are counted within the document inside the task, so nothing is
    shuffled; a task holds so many characters of text at a time."""
    return unpacked(packed_postings(docs, mode, k, weights, chars))


def packed_postings(docs: DataFrame, mode: str = "sum", k: float = 1.0, weights: dict = FIELD_WEIGHTS, chars: int = 4_000_000) -> DataFrame:
    """(term, doc_ids, tfs): the rows of ``postings``, those of one term and about so many characters of text as two arrays."""
    bump = {"sum": float, "sat": lambda c: c / (c + k), "log": lambda c: 1 + log(c)}[mode]
    name = docs.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches:
            batch = table.to_pandas()
            size = sum(batch[f].fillna("").str.len() for f in weights).cumsum() if len(batch) else batch["doc_id"]
            for _, part in batch.groupby(size // chars, sort=False):
                held: list[dict] = [{} for _ in range(len(part))]
                counted: list = []  # (field, its counts): a text that two fields have is cut once
                for f, w in weights.items():
                    had = [(part[g].to_numpy() == part[f].to_numpy(), c) for g, c in counted]
                    new = ~np.logical_or.reduce([same for same, _ in had]) if had else np.ones(len(part), bool)
                    found = iter(T.term_counts(part[f][new]))
                    mine = [next(found) if own else next(c[i] for same, c in had if same[i]) for i, own in enumerate(new)]
                    counted.append((f, mine))
                    for tf, counts in zip(held, mine):
                        for term, c in counts.items():
                            tf[term] = tf.get(term, 0.0) + w * bump(c)
                number, terms = pd.factorize(np.array([t for x in held for t in x], object))
                order = np.argsort(number, kind="stable")
                row = np.repeat(np.arange(len(part)), [len(x) for x in held])[order]
                tfs = np.array([v for x in held for v in x.values()], float)[order]
                offsets = pa.array(np.append(0, np.bincount(number, minlength=len(terms)).cumsum()), pa.int32())
                ids = table.column("doc_id").take(pa.array(np.asarray(part.index)[row]))
                yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.ListArray.from_arrays(offsets, ids), pa.ListArray.from_arrays(offsets, pa.array(tfs))], ["term", "doc_ids", "tfs"])

    return docs.select("doc_id", *weights).mapInArrow(count, f"term string, doc_ids array<{name}>, tfs array<double>")


def document_words(docs: DataFrame, field: str = "text") -> DataFrame:
    """(doc_id, words): each document's distinct terms of a field, with blanks between; terms have none."""
    name = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [" ".join(c) for c in T.term_counts(batch.column(1).to_pandas())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.string())], ["doc_id", "words"])

    return docs.select("doc_id", field).mapInArrow(cut, f"doc_id {name}, words string")


def unpacked(packed: DataFrame) -> DataFrame:
    """(doc_id, term, tf, ..) of packed postings (term, doc_ids, tfs, ..)."""
    more = [c for c in packed.columns if c not in ("term", "doc_ids", "tfs")]
    return packed.select("term", *more, F.explode(F.arrays_zip("doc_ids", "tfs")).alias("p")).select(F.col("p.doc_ids").alias("doc_id"), "term", F.col("p.tfs").alias("tf"), *more)


@dataclass
class Index:
    """A published index: postings with their bucket of the term, document frequencies, lengths, statistics."""

    postings: DataFrame
    terms: DataFrame
    lengths: DataFrame
    stats: DataFrame
    packed: DataFrame | None = None


def publish(docs: DataFrame, path: str, buckets: int = 16) -> Index:
    """Write the index of docs under path and read it. Postings are dealt by a hash of the term into ``buckets`` folders and
    sorted by term within, so a reader of few terms skips files and row groups. They are dealt and kept packed, the documents
    of a term and a piece of the corpus as one row."""
    p = packed_postings(docs).withColumn("bucket", bucket_of(F.col("term"), buckets))
    p.repartition(buckets, "bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/postings")
    spark = docs.sparkSession
    packed = spark.read.schema(p.schema).parquet(f"{path}/postings")
    posted = unpacked(packed)
    packed.groupBy("term").agg(F.sum(F.size("doc_ids")).alias("df")).withColumn("bucket", bucket_of(F.col("term"), buckets)).write.parquet(f"{path}/terms")
    doc_lengths(docs, posted).write.parquet(f"{path}/lengths")
    term_df, lengths = spark.read.parquet(f"{path}/terms"), spark.read.parquet(f"{path}/lengths")
    corpus_stats(lengths, term_df).write.parquet(f"{path}/stats")
    return opened(spark, path)


def opened(spark: SparkSession, path: str) -> Index:
    """The index that was published under path."""
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    packed = read("postings")
    return Index(unpacked(packed).select("doc_id", "term", "tf", "bucket"), read("terms"), read("lengths"), read("stats"), packed)


def few(packed: DataFrame, most: int) -> DataFrame:
    """(doc_id, term, tf) of packed postings without rows of more than ``most`` documents: all postings of terms of that df or
    less, and some of others; frequent terms are left out before anything is unpacked or dealt."""
    return unpacked(packed.where(F.size("doc_ids") <= most)).select("doc_id", "term", "tf")


def _written(df: DataFrame, path: str, kind: str, version: int) -> list[tuple]:
    """Writes df by bucket as a version, and gives the manifest's rows for the buckets that have any."""
    df.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{kind}/v{version}")
    return [(kind, r["bucket"], version) for r in df.select("bucket").distinct().collect()]  # a fixed number of buckets


def _listed(spark: SparkSession, path: str, version: int) -> dict:
    """{(kind, bucket): version that has it} as of a version."""
    rows = spark.read.parquet(f"{path}/manifest/v{version}").collect()  # a fixed number of buckets
    return {(r["kind"], r["bucket"]): r["version"] for r in rows}


def _opened(spark: SparkSession, path: str, kind: str, listed: dict, schema: str, only: set | None = None) -> DataFrame:
    out = spark.createDataFrame([], schema)
    for version in sorted({v for (k, _), v in listed.items() if k == kind}):
        paths = [f"{path}/{kind}/v{version}/bucket={b}" for (k, b), v in listed.items() if k == kind and v == version and (only is None or b in only)]
        if paths:
            read = spark.read.schema(schema).option("basePath", f"{path}/{kind}/v{version}").parquet(*paths)
            out = out.unionByName(read.select(*out.columns))
    return out


def versioned(spark: SparkSession, path: str, version: int, key: str = "bigint") -> Index:
    """The index as of a version that ``kept`` wrote."""
    listed = _listed(spark, path, version)
    read = lambda kind, schema: _opened(spark, path, kind, listed, schema)
    posted, term_df, lengths = read("postings", f"doc_id {key}, term string, tf double, bucket int"), read("terms", "term string, df bigint, bucket int"), read("lengths", f"doc_id {key}, doclen double, bucket int")
    return Index(posted, term_df, lengths, corpus_stats(lengths, term_df))


def kept(changed: DataFrame, path: str, version: int, buckets: int = 16) -> None:
    """Writes the index as of ``version`` from that before it and changed documents (doc_id, fields; a null body: removed).

    Only buckets with a touched term or document are written, under the version's own name, and a manifest tells which
    version has each bucket; the version before stays as it is, so the same batch again gives the same. Version 0 has none
    before it. Frequencies are counted again for touched terms alone.
    """
    spark, key = changed.sparkSession, changed.schema["doc_id"].dataType.simpleString()
    listed = _listed(spark, path, version - 1) if version else {}
    gone = staged(changed.select("doc_id").distinct(), "changed")
    docs = changed.where("body is not null")
    new = staged(postings(docs).withColumn("bucket", bucket_of(F.col("term"), buckets)), "new-postings")
    old = _opened(spark, path, "postings", listed, f"doc_id {key}, term string, tf double, bucket int")
    touched = staged(old.join(gone, "doc_id", "left_semi").select("term", "bucket").union(new.select("term", "bucket")).distinct(), "touched")
    of_terms = {r["bucket"] for r in touched.select("bucket").distinct().collect()}  # a fixed number of buckets
    near = _opened(spark, path, "postings", listed, f"doc_id {key}, term string, tf double, bucket int", of_terms)
    posted = near.join(gone, "doc_id", "left_anti").unionByName(new.select(*near.columns))
    rows = _written(posted, path, "postings", version)
    mine = _opened(spark, path, "postings", {(k, b): v for k, b, v in rows}, f"doc_id {key}, term string, tf double, bucket int")
    terms_before = _opened(spark, path, "terms", listed, "term string, df bigint, bucket int", of_terms)
    counted = recount(terms_before.select("term", "df"), mine, touched.select("term")).withColumn("bucket", bucket_of(F.col("term"), buckets))
    rows += _written(counted, path, "terms", version)
    by_doc = lambda d: d.withColumn("bucket", bucket_of(F.col("doc_id").cast("string"), buckets))
    of_docs = {r["bucket"] for r in by_doc(gone).select("bucket").distinct().collect()}  # a fixed number of buckets
    lengths_before = _opened(spark, path, "lengths", listed, f"doc_id {key}, doclen double, bucket int", of_docs)
    lengths = lengths_before.join(gone, "doc_id", "left_anti").unionByName(by_doc(doc_lengths(docs, new)))
    rows += _written(lengths, path, "lengths", version)
    stay = [(k, b, v) for (k, b), v in listed.items() if b not in (of_docs if k == "lengths" else of_terms)]
    spark.createDataFrame(stay + rows, "kind string, bucket int, version int").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/v{version}")
    released(gone, new, touched)


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def doc_lengths(docs: DataFrame, posted: DataFrame) -> DataFrame:
    """(doc_id, doclen): the sum of tf, 1 for a document without terms."""
    return docs.select("doc_id").join(posted.groupBy("doc_id").agg(F.sum("tf").alias("doclen")), "doc_id", "left").select("doc_id", F.coalesce("doclen", F.lit(1.0)).alias("doclen"))


def terms(posted: DataFrame) -> DataFrame:
    return posted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def corpus_stats(lengths: DataFrame, term_df: DataFrame) -> DataFrame:
    """One row: documents, mean length, terms, postings."""
    a = lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("doclen").alias("avg_doclen"))
    b = term_df.agg(F.count(F.lit(1)).alias("n_terms"), F.sum("df").alias("n_postings"))
    return a.crossJoin(b)  # one row each


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, status) of two builds' (path, mtime, size, sha): unchanged, refreshed (new time, same content), updated,
    added, removed."""
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, F.col("o.path") == F.col("n.path"), "full_outer")
    same = (F.col("o.mtime") == F.col("n.mtime")) & (F.col("o.size") == F.col("n.size"))
    status = (
        F.when(F.col("o.path").isNull(), "added").when(F.col("n.path").isNull(), "removed").when(same, "unchanged")
        .when(F.col("o.sha") == F.col("n.sha"), "refreshed").otherwise("updated")
    )
    return both.select(F.coalesce("o.path", "n.path").alias("path"), status.alias("status"))


def first_of_copies(docs: DataFrame, order: list[str]) -> DataFrame:
    """The first document of each content in the given order, and how many copies it has."""
    first = docs.groupBy("sha").agg(F.min(F.struct(*order)).alias("_first"), F.count(F.lit(1)).alias("copies"))
    mine = F.struct(*order)
    return docs.join(first, "sha").where(mine == F.col("_first")).drop("_first")


def recount(old_terms: DataFrame, posted: DataFrame, touched: DataFrame) -> DataFrame:
    """Document frequencies after touched terms changed: only those are counted again."""
    again = terms(posted.join(touched, "term", "left_semi"))
    return old_terms.join(touched, "term", "left_anti").unionByName(again)


def skeletons(term_df: DataFrame) -> DataFrame:
    """(skel, term, df) of terms a-z with df of 2 or more and a key of two letters or more."""
    return term_df.where("df >= 2").where(F.col("term").rlike("^[a-z]+$")).select(T.skeleton_key(F.col("term")).alias("skel"), "term", "df").where(F.length("skel") >= 2)


def unique_aliases(docs: DataFrame, alias: Column) -> DataFrame:
    """(alias, doc_id) of aliases that only one document has and no document is named."""
    a = docs.select("doc_id", alias.alias("alias")).where("alias is not null and alias <> ''")
    one = a.groupBy("alias").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("doc_id")).where("n = 1")
    return one.join(docs.select(F.col("name").alias("alias")), "alias", "left_anti").select("alias", "doc_id")


def kind_prefixes(docs: DataFrame) -> DataFrame:
    """(kind, prefix) with which a document's name of that kind begins."""
    made = docs.select("kind", "name", F.explode(F.array(F.concat("kind", F.lit("_")), F.concat("kind", F.lit("-")))).alias("prefix"))
    return made.where((F.col("kind") != "") & F.col("name").startswith(F.col("prefix"))).select("kind", "prefix").distinct()


def kind_aliases(docs: DataFrame, declared: DataFrame) -> DataFrame:
    """(alias, doc_id): names without their longest learned prefix, and declared short names (alias, target, doc_id) with the
    target's prefix put before them; those that two documents would have, or one is named, are left out."""
    prefixes = kind_prefixes(docs).select("prefix").distinct()
    # A prefix ends with a delimiter: all of a name's that do are looked up.
    ends = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.length("name"), F.lit(1))), lambda i: F.substring("name", F.lit(1), i)), lambda p: p.endswith("_") | p.endswith("-"))
    lead = docs.select("doc_id", "name", F.explode(ends).alias("prefix"))
    longest = lead.join(prefixes, "prefix").groupBy("doc_id", "name").agg(F.max_by("prefix", F.length("prefix")).alias("prefix"))
    bare = longest.select(F.substring("name", F.length("prefix") + 1, F.lit(1 << 20)).alias("alias"), "doc_id")
    with_prefix = declared.join(longest.select(F.col("name").alias("target"), "prefix"), "target").select(F.concat("prefix", "alias").alias("alias"), "doc_id")
    every = bare.union(with_prefix).where("alias <> ''").distinct()
    one = every.groupBy("alias").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("doc_id")).where("n = 1")
    return one.join(docs.select(F.col("name").alias("alias")), "alias", "left_anti").select("alias", "doc_id")


def name_map(docs: DataFrame, aliases: DataFrame, declared: DataFrame, by_kind: DataFrame | None = None) -> DataFrame:
    """(name, doc_id): names and aliases, then declared aliases and those by kind that shadow no name."""
    names = docs.select("name", "doc_id")
    more = declared.select(F.col("alias").alias("name"), "doc_id")
    if by_kind is not None:
        more = more.unionByName(by_kind.select(F.col("alias").alias("name"), "doc_id"))
    shadowing = more.join(names.select("name"), "name", "left_anti")
    return names.unionByName(aliases.select(F.col("alias").alias("name"), "doc_id")).unionByName(shadowing).distinct()


def resolved_names(asked: DataFrame, names: DataFrame) -> DataFrame:
    """(name, doc_id): the smallest document that a name stands for."""
    return asked.select("name").distinct().join(names, "name").groupBy("name").agg(F.min("doc_id").alias("doc_id"))


def retained_feedback(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """docs (path, identity, ..) with the weight that was kept for the same path and identity, else 1."""
    return docs.join(kept.select("path", "identity", F.col("weight").alias("_kept")), ["path", "identity"], "left").select(*docs.columns, F.coalesce("_kept", F.lit(1.0)).alias("weight"))


def corpus_languages(shares: DataFrame, least: float = 5.0) -> DataFrame:
    """(language, share) of the languages a corpus is written in: those at the bar, else the best one."""
    top = shares.agg(F.max(F.struct("share", F.lit(1).alias("_"), "language")).alias("t"))
    d = shares.crossJoin(F.broadcast(top))  # one row
    return d.where((F.col("share") >= least) | ((F.col("t.share") < least) & (F.col("language") == F.col("t.language")))).select("language", "share")


def language_shares(posted: DataFrame, markers: DataFrame, n_docs: DataFrame) -> DataFrame:
    """(language, share): the median over its marker words of the share of documents that hold one, in per cent."""
    held = posted.join(F.broadcast(markers), posted["term"] == markers["marker"]).groupBy("language", "marker").agg(F.countDistinct("doc_id").alias("n"))
    every = markers.join(held, ["language", "marker"], "left").select("language", F.coalesce("n", F.lit(0)).alias("n")).crossJoin(n_docs)  # one row
    return every.groupBy("language").agg(F.percentile(F.col("n") * 100.0 / F.col("n_docs"), F.lit(0.5)).alias("share"))
