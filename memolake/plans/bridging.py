"""Queries of the bridge between scripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memolake.functions import text as T
from memolake.operators import bridge, index
from memolake.sources import corpus
from memolake.tables import staged

QUERIES: dict = {}
SQL: dict = {}

_FIRST, _VOWELS = "gndrmbsjktph", "aeiou"
#: Syllable blocks of these consonants and vowels, vowel by vowel.
_BLOCKS = "".join(chr(0xAC00 + 588 * bridge.INITIALS.index(c) + 28 * bridge.VOWELS.index(v)) for c in _FIRST for v in _VOWELS)


def query(f):
    QUERIES[f.__name__] = f
    return f


def hangul(word: Column) -> Column:
    """A word of consonants and vowels in turn, in syllable blocks."""
    at = lambda i, of: F.instr(F.lit(of), F.substring(word, i, F.lit(1)))
    block = lambda i: F.substring(F.lit(_BLOCKS), (at(2 * i - 1, _FIRST) - 1) * len(_VOWELS) + at(2 * i, _VOWELS), F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(1), (F.length(word) / 2).cast("int")), block), "")


def spelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, every other one with its words of plain syllables written in Hangul besides."""
    d = corpus.documents(spark, sf_dir)
    plain = F.filter(F.array_distinct(T.latin_words(F.col("body"))), lambda w: w.rlike(f"^([{_FIRST}][{_VOWELS}]){{2,6}}$"))
    return d.withColumn("hangul", F.transform(plain, hangul)).withColumn("body", F.when(F.col("doc_id") % 2 == 0, F.concat_ws(" ", "body", F.array_join("hangul", " "))).otherwise(F.col("body")))


@query
def t11_romanised(spark, sf_dir):
    return bridge.romanisations(spelled(spark, sf_dir).select(F.explode("hangul").alias("word")))


@query
def m6_bridged(spark, sf_dir):
    d = spelled(spark, sf_dir)
    posted = staged(index.postings(d).select("doc_id", "term"), "postings")
    terms = index.terms(posted)
    words = d.where("doc_id % 2 = 0").select(F.explode("hangul").alias("word")).distinct()
    return bridge.bridged(words, posted, terms, d.count())
