"""From Hangul words to Latin terms of the corpus that they spell.

Rules write a word in Latin letters in many ways; the corpus tells which of them are terms, near a term, or share the
consonants of one. A pair holds only if word and term stand in the same documents often enough.

Nothing compares all words with all terms. Near terms meet by what is left of both after deletions behind the first two
letters (two strings within k edits have a common rest after k deletions each), like consonants by equal keys, keys one
consonant apart by a deletion on either side. Documents meet only for pairs that were found.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations, product

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memolake.functions import text as T
from memolake.tables import staged

# Latin spellings of initials, vowels and finals in the order of the syllable block, and other spellings of some.
INITIALS = ["g", "kk", "n", "d", "tt", "r", "m", "b", "pp", "s", "ss", "", "j", "jj", "ch", "k", "t", "p", "h"]
OTHER_INITIALS = {0: ["k"], 5: ["l"], 7: ["v", "p"], 9: ["sh"], 12: ["z"], 15: ["c"], 17: ["f"], 11: [""]}
VOWELS = ["a", "ae", "ya", "yae", "eo", "e", "yeo", "ye", "o", "wa", "wae", "oe", "yo", "u", "wo", "we", "wi", "yu", "eu", "ui", "i"]
OTHER_VOWELS = {1: ["a", "e"], 4: ["e", "u", "o"], 8: ["o", "au"], 13: ["oo", "u"], 18: ["", "u"], 20: ["y", "ee", "i"], 11: ["o"], 19: ["i"]}
FINALS = ["", "k", "k", "k", "n", "n", "n", "t", "l", "l", "l", "l", "l", "l", "l", "l", "m", "p", "p", "t", "t", "ng", "t", "t", "k", "t", "p", "t"]
OTHER_FINALS = {1: ["c", "ck"], 17: ["b"], 21: ["n"], 8: ["ll", "r"]}
# Endings of loan words; doubled letters that one sound is; sounds that spellings take for each other.
ENDINGS = [("syeon", "tion"), ("syeon", "sion"), ("syon", "tion"), ("syon", "sion"), ("ji", "ge"), ("csi", "xy"), ("ksi", "xy")]
DOUBLED = "bcdfghjklmnprstvz"
ALIKE = ["ck", "kc", "fp", "pf", "lr", "rl", "sz", "zs", "bv", "vb", "jz"]
CONSONANTS = "bdghjkmnprstw"
# Widths of the search, bounds of a term and of a pair.
BEAM, MOST, PROBES = 64, 120, 24
LEAST_DF, MOST_SHARE = 2, 0.35
LETTERS, LETTERS_LONG, MOST_LETTERS, LONG = 2.0, 1.5, 4.5, 3
KEY, BY_KEY, LOOSE = 3, 5, 5
TOGETHER, SHARE, LIFT = 1, 0.12, 1.2

_DOUBLE = re.compile(f"([{DOUBLED}])\\1")


def _spellings(block: str) -> list[tuple[int, str]]:
    """(departures from the first choice, spelling) of a syllable: fewest departures first, short ones before long."""
    initial, rest = divmod(ord(block) - 0xAC00, 588)
    vowel, final = divmod(rest, 28)
    ways = [[first[i], *(x for x in other.get(i, []) if x != first[i])] for first, other, i in ((INITIALS, OTHER_INITIALS, initial), (VOWELS, OTHER_VOWELS, vowel), (FINALS, OTHER_FINALS, final))]
    least: dict = {}
    for choice in product(*map(enumerate, ways)):
        spelled = "".join(x for _, x in choice)
        least[spelled] = min(sum(i > 0 for i, _ in choice), least.get(spelled, 3))
    return sorted(((n, s) for s, n in least.items() if s), key=lambda x: (x[0], len(x[1])))


def romanised(word: str) -> list[str]:
    """At most 120 Latin spellings of a word of Hangul syllables, the short ones first; none for other words."""
    if not word or not all("가" <= c <= "힣" for c in word):
        return []
    short = lambda x: (len(x[1]), x[0])
    beam = [(0, "")]
    for block in word:
        beam = sorted(((a + b, s + t) for (a, s), (b, t) in product(beam, _spellings(block))), key=short)[:BEAM]
    beam += [(n, once) for n, s in beam if (once := _DOUBLE.sub(r"\1", s)) != s]
    beam += [(n + 1, s.removesuffix(old) + new) for n, s in beam for old, new in ENDINGS if s.endswith(old)]
    least: dict = {}
    for n, s in beam:
        if 2 <= len(s) <= 24:
            least[s] = min(n, least.get(s, n))
    return [s for _, s in sorted(((n, s) for s, n in least.items()), key=short)[:MOST]]


def romanisations(words: DataFrame) -> DataFrame:
    """(word, place, spelling) of distinct words (word): the spellings of Hangul words in order."""

    def spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(w, i, s) for w in batch["word"] for i, s in enumerate(romanised(w))]
            yield pd.DataFrame(rows, columns=["word", "place", "spelling"])

    return words.where(F.col("word").rlike(f"^[{T.HANGUL}]+$")).select("word").distinct().mapInPandas(spell, "word string, place int, spelling string")


def deletions(word: Column, least: int, most: int) -> Column:
    """Distinct strings that are left of a word after ``least`` to ``most`` deletions."""

    @F.pandas_udf("array<string>")
    def cut(words: pd.Series) -> pd.Series:
        kept = lambda w: {"".join(x) for k in range(least, most + 1) if k <= len(w) for x in combinations(w, len(w) - k)}
        return words.map(lambda w: sorted(kept(w)))

    return cut(word)


def consonants_follow(spelling: Column, term: Column) -> Column:
    """Whether the spelling's consonants stand in the term in order, like sounds taken for each other; of four or more one may miss."""
    bones = F.regexp_replace(spelling, "[aeiouy]", "")
    step = lambda i, c: F.when((c == F.substring(bones, i + 1, F.lit(1))) | F.concat(c, F.substring(bones, i + 1, F.lit(1))).isin(ALIKE), i + 1).otherwise(i)
    found = F.aggregate(F.split(term, ""), F.lit(0), step)
    n = F.length(bones)
    return (n > 0) & (found >= n - F.when(n >= 4, 1).otherwise(0))


def attempts(words: DataFrame, terms: DataFrame, n_docs: int) -> DataFrame:
    """(word, term, df, attempt): terms (term, df) that Hangul words (word) may spell, in the order in which they are tried:
    the most frequent term that is a spelling, the most frequent one near a spelling, then of words of three syllables those
    with the same consonants, and of words of five those with one more or less; at most five by consonants."""
    most = max(LEAST_DF + 1, int(n_docs * MOST_SHARE))
    usable = terms.where(F.col("df").between(LEAST_DF, most)).select("term", "df")
    n = F.length("word")
    low, high = F.floor(n * F.when(n >= LONG, LETTERS_LONG).otherwise(LETTERS)), F.floor(n * MOST_LETTERS) + 1
    spelled = staged(romanisations(words.where(n > 1)), "romanised")
    fits = F.length("term").between(low, high)
    best = lambda d, *ties: d.withColumn("_r", F.row_number().over(Window.partitionBy("word").orderBy(F.desc("df"), *ties))).where("_r = 1").select("word", "term", "df")

    direct = best(spelled.join(usable, F.col("spelling") == F.col("term")).where(fits), "place").withColumn("attempt", F.lit(0))

    probes = spelled.where((F.col("place") < PROBES) & (F.length("spelling") >= 4))
    limit = F.when(F.length("spelling") <= 6, 1).otherwise(2)
    # Short spellings (6 letters) and terms (7) meet by one deletion, long ones (7, 5) by two; the flag keeps them apart.
    rest = lambda c, k: F.explode(deletions(F.substring(c, 3, 100), 0, k))
    mine = probes.where("length(spelling) <= 6").select("*", F.lit(1).alias("k"), rest("spelling", 1).alias("left")).union(probes.where("length(spelling) > 6").select("*", F.lit(2).alias("k"), rest("spelling", 2).alias("left")))
    mine = mine.withColumn("begin", F.substring("spelling", 1, 2))
    others = usable.withColumn("begin", F.substring("term", 1, 2)).join(mine.select("begin").distinct(), "begin", "left_semi").where(F.length("term").between(3, 26))
    others = others.where("length(term) <= 7").select("*", F.lit(1).alias("k"), rest("term", 1).alias("left")).union(others.where("length(term) >= 5").select("*", F.lit(2).alias("k"), rest("term", 2).alias("left")))
    met = mine.join(others, ["begin", "k", "left"]).where(fits).select("word", "spelling", "term", "df").distinct()
    near = best(met.where((F.levenshtein("spelling", "term") <= limit) & consonants_follow(F.col("spelling"), F.col("term"))), "term").withColumn("attempt", F.lit(1))

    keys = probes.where(n >= LONG).select("word", T.skeleton_key(F.col("spelling")).alias("key")).where(F.length("key") >= KEY).distinct()
    boned = usable.where(F.col("term").rlike("^[a-z]+$")).withColumn("key", T.skeleton_key(F.col("term"))).where(F.length("key") >= KEY)
    same = keys.join(boned, "key").select("word", "term", "df")
    five = keys.where(n >= LOOSE)
    fewer = five.select("word", F.explode(deletions(F.col("key"), 1, 1)).alias("key")).join(boned, "key").select("word", "term", "df")
    one_of = F.array_distinct(F.filter(F.transform(F.sequence(F.lit(1), F.length("key")), lambda i: F.when(F.contains(F.lit(CONSONANTS), F.substring("key", i, F.lit(1))), F.concat(F.substring("key", F.lit(1), i - 1), F.substring("key", i + 1, F.lit(100))))), lambda x: x.isNotNull()))
    more = five.join(boned.select("term", "df", F.explode(one_of).alias("key")), "key").select("word", "term", "df")
    first = F.row_number().over(Window.partitionBy("word").orderBy(F.desc("df"), "term"))
    by_key = lambda d, base: d.where(fits).distinct().withColumn("attempt", first + base).where(F.col("attempt") <= base + BY_KEY)
    loose = by_key(same.join(five.select("word").distinct(), "word", "left_semi").union(fewer).union(more), 1 + BY_KEY)
    found = direct.union(near).union(by_key(same, 1)).union(loose)
    return found.groupBy("word", "term", "df").agg(F.min("attempt").alias("attempt"))


def bridged(words: DataFrame, postings: DataFrame, terms: DataFrame, n_docs: int) -> DataFrame:
    """(word, term, attempt, docs, together, share, lift): the Latin term of each Hangul word (word) that has one.

    postings (doc_id, term), terms (term, df). A word is in the documents that have all of its grams that any document has.
    Of the attempts in order the first counts whose term is in a share of 0.12 of the word's documents, and 1.2 times as
    often there as anywhere. A null or other word, and one of one syllable, has none; ties go to the smaller term."""
    tries = staged(attempts(words, terms, n_docs), "attempts")
    grams = tries.select("word").distinct().select("word", F.explode(F.array_distinct(T.grams(F.col("word")))).alias("term")).join(terms.select("term"), "term", "left_semi")
    held = postings.select("doc_id", "term").join(grams, "term").groupBy("word", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    inside = staged(held.join(grams.groupBy("word").agg(F.count(F.lit(1)).alias("n")), ["word", "n"]).select("word", "doc_id"), "holders")
    docs = inside.groupBy("word").agg(F.count(F.lit(1)).alias("docs"))
    latin = postings.select("doc_id", "term").join(tries.select("term").distinct(), "term", "left_semi")
    both = inside.join(tries.select("word", "term"), "word").join(latin, ["doc_id", "term"]).groupBy("word", "term").agg(F.count(F.lit(1)).alias("together"))
    share = F.col("together") / F.col("docs")
    pairs = tries.join(both, ["word", "term"]).join(docs, "word").withColumn("share", share).withColumn("lift", share / (F.col("df") / F.lit(n_docs)))
    good = pairs.where((F.col("together") >= TOGETHER) & (F.col("share") >= SHARE) & (F.col("lift") >= LIFT))
    first = F.row_number().over(Window.partitionBy("word").orderBy("attempt"))
    return good.withColumn("_r", first).where("_r = 1").select("word", "term", "attempt", "docs", "together", "share", "lift")
