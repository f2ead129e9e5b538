"""From raw documents to packed sequences: each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from memolake.llm.common import staged, table
from memolake.llm.jaccard import one_of_each
from memolake.llm.language import recognised
from memolake.llm.mixing import mix
from memolake.llm.packing import packed, vocabulary


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is recognised. Those with a null text, or without a letter, go, and no others. Rows with a null
    id stay and aren't learned from; repeated rows stay; other columns stay as they are; an empty table gives no rows."""
    return recognised(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8 or more: that of the smallest doc_id, null
    ids last. Documents without words stay; rows that repeat a kept one's id and text go; other columns stay as they are."""
    return one_of_each(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for, at most three times. A null source is a source; null and empty texts
    have size 0 and follow their source's rate; repeated rows are documents of their own; an empty table gives no rows."""
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in the packed sequences. A null text is empty and has only the end id; null ids
    and repeated rows are documents of their own; an empty table gives no rows."""
    # Workers still hold what earlier stages loaded, so this one keeps less.
    return packed(docs, vocabulary(), keep=250_000)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("source_mix", source_mix),
    ("packing", packing),
]

#: Packing can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = staged(docs, name)
    return docs
