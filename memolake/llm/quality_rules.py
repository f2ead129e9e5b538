"""Quality rules with risk-controlled thresholds (operator 13).

Each rule compares one measure of a text with a cutoff. Cutoffs are chosen per stratum from labelled documents: good ones
(quality 1) that a rule rejects are false rejections. Labelled documents are dealt to two folds by the hash of their text, so
that copies are in one fold.

1. On the tuning fold every rule has, for each tolerated share of good documents (``TOLERATED``), the mildest cutoff of its
   grid that rejects most bad documents within that share. That gives each stratum a ladder of rule sets, each at least as
   severe as the one before.
2. On the holdout fold each rule set is tested as a whole: with k of n good documents rejected by any of its rules, it is
   certified if a binomial of n draws at the rate ``RISK`` gives k or fewer with a chance of at most the level, i.e. if the
   exact (Clopper-Pearson) upper bound of its false rejection rate is at most ``RISK``. The level is ``ERROR`` over the number
   of all tests (strata times rule sets), so with a chance of 1 - ``ERROR`` every certified set of every stratum keeps its
   limit.
3. Of the certified sets of a stratum that which rejects most bad holdout documents is used, the mildest among equals. A
   stratum without a certified one (too few labels, say) rejects nothing.

Texts are read once and become narrow rows of measures; labels, tallies and verdicts are joins and partial sums of those. The
tallies have one row per stratum, rule and cutoff.

Defined results: a null or empty text has no words, so it fails the base rules; a null stratum is one of its own; documents
without labels take no part in the choice, nor do ids labelled both good and bad, or null ids; repeated rows and copies are
documents of their own; empty tables give no rows, or no cutoffs; other columns don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memolake.llm.common import give_back, small_batches, staged, table
from memolake.llm.hashing import blocks
from memolake.tables import little

#: At most this share of good documents may be rejected in a stratum, but for this chance.
RISK, ERROR = 0.05, 0.05
#: Good documents of the tuning fold that a rule may reject, in thousandths; one rule set for each.
TOLERATED = (0, 1, 2, 5, 10)
#: One in so many labelled texts is for tuning, the others are the holdout.
TUNING = 4
LEAST_WORDS, REPEATED = 50, 50

#: Rules: what a text may have of how much (in thousandths), and the cutoffs that can be chosen, mildest first.
RULES = {
    "symbols": ("n_symbols", "word_chars", (400, 200, 100, 50, 30, 20, 10, 5)),
    "capitals": ("n_capitals", "word_chars", (700, 500, 400, 300, 250, 200, 150, 100)),
    "long_words": ("word_chars", "n_words", (15000, 12000, 10000, 9000, 8000, 7500, 7000, 6500)),
    "short_words": ("n_words", "word_chars", (500, 450, 400, 350, 325, 300, 275, 250)),
    "repeated_lines": ("n_dup_lines", "n_lines", (700, 500, 400, 300, 200, 150, 100, 50)),
    "repeated_words": ("n_repeat_words", "n_words", (500, 450, 400, 350, 300, 250, 200, 150)),
}
#: In place of a cutoff: a rule that isn't used.
OFF = 99
MEASURES = ("n_words", "word_chars", "n_symbols", "n_capitals", "n_lines", "n_dup_lines", "n_repeat_words")

_KINDS = np.zeros(256, np.uint8)
_KINDS[[*b"#*$%&|<>"]] = 1
_KINDS[65:91] = 2
_KINDS[[9, 10, 11, 12, 13, 32, *range(128, 192)]] = 4  # blanks, and bytes that go on with a character


def repeated_words(words: list[bytes], text: np.ndarray, n: int) -> np.ndarray:
    """How many words of each of n texts are in a window of three words that the text holds twice or more; text: of each word."""
    out = np.zeros(n, np.int64)
    if len(words) < 4:
        return out
    values = np.empty(len(words), object)
    values[:] = words
    first = codes = pd.factorize(values)[0].astype(np.int64)
    for ahead in (1, 2):
        codes = pd.factorize(codes[: len(words) - ahead] * len(words) + first[ahead:])[0].astype(np.int64)
    inside = np.flatnonzero(text[:-2] == text[2:])
    kinds = pd.factorize(text[inside] * len(words) + codes[inside])[0]
    at = inside[np.bincount(kinds)[kinds] > 1] if len(inside) else inside
    within = np.zeros(len(words), bool)
    for ahead in range(3):
        within[at + ahead] = True
    np.add.at(out, text[within], 1)
    return out


def measured(texts: list[str]) -> pd.DataFrame:
    """MEASURES of each text."""
    rows, all_words = [], []
    for t in texts:
        b = t.encode("utf-8", "surrogatepass")
        words = b.split()
        kinds = np.bincount(_KINDS[np.frombuffer(b, np.uint8)], minlength=5)
        lines = [x for x in b.split(b"\n") if x.strip()]
        rows.append((len(words), len(b) - int(kinds[4]), int(kinds[1]), int(kinds[2]), len(lines), len(lines) - len(set(lines))))
        all_words.append(words)
    out = pd.DataFrame(rows, columns=MEASURES[:-1], dtype="int64")
    text = np.repeat(np.arange(len(texts)), [len(w) for w in all_words])
    out["n_repeat_words"] = repeated_words([w for words in all_words for w in words], text, len(texts))
    return out


def with_measures(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """(doc_id, stratum, fold, MEASURES) of each document."""

    @F.pandas_udf(", ".join(f"{m} long" for m in MEASURES))
    def measure(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts = part.tolist()
            yield pd.concat([measured(texts[a:b]) for a, b in blocks(texts)] or [measured([])], ignore_index=True)
        give_back()

    whole = F.coalesce(F.col(text), F.lit(""))
    key = F.when(F.col(stratum).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(stratum).cast("string")))
    fold = F.when(F.conv(F.substring(F.md5(whole), 1, 4), 16, 10).cast("int") % TUNING == 0, "tuning").otherwise("holdout")
    return small_batches(docs).select(F.col(doc_id).alias("doc_id"), key.alias("stratum"), fold.alias("fold"), measure(whole).alias("m")).select("doc_id", "stratum", "fold", "m.*")


def base_failed() -> Column:
    """Too few words, or more than half of them in repeated windows."""
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words"))


def exceeded(share: str, of: str, cutoffs: tuple) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, cutoffs)), lambda c: 1000 * F.col(share) > c * F.col(of)))


def levels(rules: dict = RULES) -> Column:
    """How many of its cutoffs each rule's measure exceeds, in the order of the rules: of the mildest first."""
    return F.array(*[exceeded(*rule) for rule in rules.values()])


def rejected(levels: Column, cutoffs: Column) -> Column:
    """Whether any rule's level reaches the place of its cutoff (from 1)."""
    return F.exists(F.zip_with(levels, cutoffs, lambda a, b: a >= b), lambda x: x)


def chance(k: int, n: int, p: float) -> float:
    """That a binomial of n draws at rate p is k or less. Terms 60 deviations below k and farther are nothing in doubles."""
    if k >= n:
        return 1.0
    j = np.arange(max(0, k - 60 * math.isqrt(k + 1) - 60), k + 1)
    logs = np.zeros(len(j))
    logs[:-1] = np.cumsum((np.log(j[1:]) - np.log(n - j[1:] + 1) + math.log1p(-p) - math.log(p))[::-1])[::-1]
    top = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    most = logs.max()
    return min(1.0, math.exp(top + most + math.log(np.exp(logs - most).sum())))


def upper_bound(k: int, n: int, level: float) -> float:
    """Exact upper bound of a rate of which k in n draws were seen: the rate at which so few have the chance ``level``."""
    if k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(50):
        mid = (low + high) / 2
        low, high = (mid, high) if chance(k, n, mid) > level else (low, mid)
    return high


def thresholds(measures: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", quality: str = "quality", rules: dict = RULES, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """The tested rule sets: (stratum, tolerated, cutoffs, n_good, good_rejected, bad_rejected, bound, used).

    cutoffs has the place of each rule's cutoff in its grid from 1, or ``OFF``; bound is the exact upper bound of the false
    rejection rate at the corrected level; used marks the set of each stratum that is certified and chosen, if any.
    measures: as from ``with_measures``; documents that fail the base rules take no part."""
    known = labels.where(F.col(quality).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id"))
    known = known.agg(F.min(quality).cast("long").alias("good"), F.max(quality).alias("_max")).where("good = _max").drop("_max")
    labelled = measures.where(~base_failed()).join(known, F.col("doc_id") == F.col("_id"))
    labelled = staged(labelled.select("stratum", "fold", "good", levels(rules).alias("levels")), "labelled")
    tests = labelled.select("stratum").distinct().count() * len(TOLERATED)

    tuning = labelled.where("fold = 'tuning'")
    at = tuning.select("stratum", "good", F.posexplode("levels").alias("rule", "level")).groupBy("stratum", "rule", "level")
    at = at.agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad")).where("level > 0")
    at = at.withColumn("cutoff", F.explode(F.sequence(F.lit(1), "level"))).groupBy("stratum", "rule", "cutoff").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    all_good = tuning.groupBy("stratum").agg(F.sum("good").alias("n_good"))
    at = at.join(all_good, "stratum").withColumn("tolerated", F.explode(F.array(*map(F.lit, TOLERATED)))).where("bad > 0 AND 1000 * good <= tolerated * n_good")
    at = at.groupBy("stratum", "tolerated", "rule").agg(F.max_by("cutoff", F.struct("bad", -F.col("cutoff"))).alias("cutoff"))
    sets = at.groupBy("stratum", "tolerated").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("by_rule"))
    sets = sets.select("stratum", "tolerated", F.array(*[F.coalesce(F.try_element_at("by_rule", F.lit(i)), F.lit(OFF)) for i in range(len(rules))]).alias("cutoffs"))

    held = labelled.where("fold = 'holdout'").join(little(sets, 10_000), "stratum").withColumn("out", rejected(F.col("levels"), F.col("cutoffs")).cast("long"))
    tested = held.groupBy("stratum", "tolerated", "cutoffs").agg(F.sum("good").alias("n_good"), F.sum(F.col("good") * F.col("out")).alias("good_rejected"), F.sum((1 - F.col("good")) * F.col("out")).alias("bad_rejected"))

    @F.pandas_udf("double")
    def bound(k: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([upper_bound(int(a), int(b), error / tests) for a, b in zip(k, n)], dtype="float64")

    fit = (F.col("bound") <= risk) & (F.col("bad_rejected") > 0)
    first = F.row_number().over(Window.partitionBy("stratum").orderBy(fit.desc(), F.desc("bad_rejected"), "tolerated"))
    return tested.withColumn("bound", bound("good_rejected", "n_good")).withColumn("used", fit & (first == 1))


def judged(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", stratum: str = "lang", label_id: str = "doc_id", quality: str = "quality", **options) -> DataFrame:
    """(doc_id, stratum, MEASURES, base_failed, kept) of each document."""
    measures = staged(with_measures(docs, doc_id=doc_id, text=text, stratum=stratum), "measures")
    sets = staged(thresholds(measures, labels, doc_id=label_id, quality=quality, **options), "thresholds")
    used = sets.where("used").select("stratum", "cutoffs")
    out = measures.join(little(used, 10_000), "stratum", "left").withColumn("base_failed", base_failed())
    kept = ~F.col("base_failed") & ~F.coalesce(rejected(levels(options.get("rules", RULES)), F.col("cutoffs")), F.lit(False))
    return out.select("doc_id", "stratum", *MEASURES, "base_failed", kept.alias("kept"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _level_sql(x: str, y: str, cutoffs: tuple) -> str:
    return f"len(list_filter({[*cutoffs]}, lambda c: 1000 * {x} > c * {y}))"


BLANK = "\\x20\\x09-\\x0D"
OP13_SQL = f"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, CASE WHEN lang IS NULL THEN 'n' ELSE 's' || lang END AS stratum, coalesce(text, '') AS text FROM documents),
words AS (SELECT *, regexp_extract_all(text, '[^{BLANK}]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^{BLANK}]')) AS lines FROM texts),
windows AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS t FROM words),
twice AS (SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY r, t) AS n FROM windows) WHERE n > 1),
again AS (SELECT r, count(DISTINCT i + j) AS n FROM twice, range(3) x(j) GROUP BY r),
measures AS (SELECT r, doc_id, stratum, ('0x' || substr(md5(text), 1, 4))::INT % {TUNING} = 0 AS tuning, len(w) AS n_words, length(regexp_replace(text, '[{BLANK}]+', '', 'g')) AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, length(regexp_replace(text, '[^A-Z]+', '', 'g')) AS n_capitals,
  len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM words LEFT JOIN again USING (r)),
based AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEATED} * n_words AS base_failed, [{", ".join(_level_sql(*r) for r in RULES.values())}] AS levels FROM measures),
labelled AS (SELECT b.*, good FROM based b JOIN (SELECT doc_id, min(quality) AS good FROM labels WHERE quality IN (0, 1) GROUP BY doc_id HAVING min(quality) = max(quality)) USING (doc_id) WHERE NOT base_failed),
tallies AS (SELECT stratum, rule, cutoff, tolerated, sum(good) AS good, sum(1 - good) AS bad FROM labelled, range(1, {len(RULES) + 1}) x(rule), range(1, 9) y(cutoff), (SELECT unnest({[*TOLERATED]}) AS tolerated)
  WHERE tuning AND levels[rule] >= cutoff GROUP BY ALL),
picked AS (SELECT stratum, tolerated, rule, cutoff FROM tallies JOIN (SELECT stratum, sum(good) AS n_good FROM labelled WHERE tuning GROUP BY stratum) USING (stratum)
  WHERE bad > 0 AND 1000 * good <= tolerated * n_good QUALIFY row_number() OVER (PARTITION BY stratum, tolerated, rule ORDER BY bad DESC, cutoff) = 1),
held AS (SELECT l.r, stratum, tolerated, good, max((levels[rule] >= cutoff)::INT) AS out FROM labelled l JOIN picked USING (stratum) WHERE NOT tuning GROUP BY ALL),
tested AS (SELECT stratum, tolerated, sum(good) AS n, sum(good * out) AS k, sum((1 - good) * out) AS bad FROM held GROUP BY ALL),
certified AS (SELECT stratum, tolerated FROM tested WHERE bad > 0 AND k < n
  AND list_sum(list_transform(range(k::BIGINT + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({RISK}::DOUBLE) + (n - j) * ln(1 - {RISK}::DOUBLE)))) <= {ERROR}::DOUBLE / ({len(TOLERATED)} * (SELECT count(DISTINCT stratum) FROM labelled))
  QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY bad DESC, tolerated) = 1),
outs AS (SELECT DISTINCT r FROM based JOIN certified USING (stratum) JOIN picked USING (stratum, tolerated) WHERE levels[rule] >= cutoff)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  base_failed, NOT base_failed AND o.r IS NULL AS kept FROM based b LEFT JOIN outs o ON b.r = o.r"""
