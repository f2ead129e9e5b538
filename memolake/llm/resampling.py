"""Importance resampling towards a target distribution (operator 12), with a head-tail vocabulary.

Features are runs of one to three words, hashed to buckets by the CRC-32 of their bytes. The CRC of a run goes on from that
of its first words, so two bounded tables are broadcast: the CRC states of the most frequent words (``HEAD``) and those of
the most frequent pairs of them (``PAIRS``), which are also the states that longer runs go on from. All others, the tail,
take their CRC directly from the bytes. Both ways give the same exact number: what is in the tables changes the work, never a
bucket. Words and pairs are counted over all texts, with partial counts in each task.

Bucket totals of the documents and of the target are summed in the tasks (10,000 numbers each), added up by Spark and become
one table of gains. A document's weight is the sum of its features' gains; its score adds Gumbel noise from its id, and the
highest scores are a draw without replacement in proportion to e^(weight / 1000).

Ranks come from a range partitioning by score: places within a range and a running sum over the ranges' sizes, so that no
task orders more than its range. The ranges are written to the shared folder, so a lost executor can't deal them anew.

Defined results: a null or empty text has no features and weight 0; a null id is hashed as an empty one and comes after
others of its score; repeated rows are documents of their own, with the same score and a rank each; an empty table gives no
rows, an empty target the gains of its zero counts; other columns don't matter.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memolake.llm.common import LOWER, UPPER, give_back, input_partitions, released, small_batches, staged, table
from memolake.llm.hashing import blocks

BUCKETS, SEED, PERCENT, LEAST_WORDS = 10_000, "42", 5, 20
#: Words of up to so many bytes can be in the head; so many words and pairs of them at most are broadcast.
HEAD, PAIRS, HEAD_BYTES = 4096, 65_536, 32
#: A task hands on its counts when it holds so many.
HELD = 300_000
#: Rows of a range that is ordered in one task, about.
RANGE_ROWS = 2_000_000

#: A-Z lowered, and blanks for all ASCII characters but letters and digits.
BYTES = bytes(i + 32 if 65 <= i <= 90 else i if i > 127 or 48 <= i <= 57 or 97 <= i <= 122 else 32 for i in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(BYTES).split()


class Vocabulary:
    """CRC states of frequent words and of frequent pairs of them."""

    def __init__(self, words: list[bytes], pairs: np.ndarray):
        self.ids = {w: i for i, w in enumerate(words)}
        self.states = {w: crc32(w) for w in words}
        self.pairs = np.append(np.sort(pairs), np.int64(1) << 62)
        self.pair_states = np.array([crc32(words[k // HEAD] + b" " + words[k % HEAD]) for k in self.pairs[:-1].tolist()] + [0], np.int64)

    def keys(self, words: list[bytes]) -> np.ndarray:
        """Numbers of the pairs of neighbours that are both in the head, else -1."""
        ids = np.fromiter((self.ids.get(w, -1) for w in words), np.int64, len(words))
        return np.where((ids[:-1] >= 0) & (ids[1:] >= 0), ids[:-1] * HEAD + ids[1:], -1)

    def features(self, words: list[bytes]) -> list[np.ndarray]:
        """CRC-32 of the runs of one, two and three words that begin at each place."""
        known = self.states.get
        one = [known(w) or crc32(w) for w in words]
        if len(words) < 2:
            return [np.array(one, np.int64), *[np.zeros(0, np.int64)] * 2]
        more = [b" " + w for w in words[1:]]
        keys = self.keys(words)
        at = np.searchsorted(self.pairs, keys)
        two = self.pair_states[at]
        tail = np.flatnonzero(self.pairs[at] != keys)
        two[tail] = [crc32(more[i], one[i]) for i in tail.tolist()]
        return [np.array(one, np.int64), two, np.array([*map(crc32, more[1:], two.tolist())], np.int64)]


def bucketed(texts: list[list[bytes]], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text's place) of each feature of the texts; no run crosses from one to the next."""
    text = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    found, of = [], []
    for i, states in enumerate(vocabulary.features([w for t in texts for w in t])):
        whole = text[: len(text) - i] == text[i:] if len(text) > i else np.zeros(0, bool)
        found.append(states[: len(whole)][whole] % BUCKETS)
        of.append(text[: len(whole)][whole])
    return np.concatenate(found), np.concatenate(of)


def only_text(df: DataFrame, text: str) -> DataFrame:
    return small_batches(df.select(F.coalesce(F.col(text), F.lit("")).alias("text")))


def texts_in(batch: pd.DataFrame) -> Iterator[list[list[bytes]]]:
    texts = batch["text"].tolist()
    for a, b in blocks(texts):
        yield [words_of(t) for t in texts[a:b]]


def counted(df: DataFrame, tallies, schema: str) -> DataFrame:
    """Sums by key of what ``tallies(texts)`` counts, keys as in the schema "key type, n long"."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        for batch in batches:
            for texts in texts_in(batch):
                held.update(tallies(texts))
                if len(held) > HELD:
                    yield pd.DataFrame({"key": [*held], "n": [*held.values()]})
                    held = Counter()
        if held:
            yield pd.DataFrame({"key": [*held], "n": [*held.values()]})
        give_back()

    return df.mapInPandas(count, schema).groupBy("key").agg(F.sum("n").alias("n"))


def frequent(df: DataFrame, n: int) -> list:
    """At most n of the keys counted most often: those above a count that so many are above. Counts are first told in bands of
    an eighth of a binary order, some hundred rows at any size, so no more than n keys ever leave the tasks."""
    counts = staged(df, "counts")
    band = F.floor(F.log2("n") * 8)
    cut, held = 0, 0
    for r in sorted(counts.groupBy(band.alias("band")).count().collect(), reverse=True):
        if held + r["count"] > n:
            cut = r["band"] + 1
            break
        held += r["count"]
    keys = sorted(r["key"] for r in counts.where(band >= cut).select("key").collect())
    released(counts)
    return keys


def frequent_vocabulary(texts: DataFrame, head: int = HEAD, pairs: int = PAIRS) -> Vocabulary:
    """From a table of one column ``text``."""
    words = counted(texts, lambda found: Counter(w.decode("utf-8", "surrogatepass") for w in (w for t in found for w in t) if len(w) <= HEAD_BYTES), "key string, n long")
    known = Vocabulary([w.encode("utf-8", "surrogatepass") for w in frequent(words, head)], np.zeros(0, np.int64))

    def pairs_in(found: list[list[bytes]]) -> dict:
        text = np.repeat(np.arange(len(found)), [len(t) for t in found])
        keys = known.keys([w for t in found for w in t])
        kinds, n = np.unique(keys[(keys >= 0) & (text[:-1] == text[1:])], return_counts=True)
        return dict(zip(kinds.tolist(), n.tolist()))

    found = frequent(counted(texts, pairs_in, "key long, n long"), pairs)
    return Vocabulary([*known.ids], np.array(found, np.int64))


def bucket_totals(texts: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """Features of all texts by bucket: 10,000 numbers, whatever the number of texts."""
    known = texts.sparkSession.sparkContext.broadcast(vocabulary)

    def total(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for words in texts_in(batch):
                n += np.bincount(bucketed(words, known.value)[0], minlength=BUCKETS)
        yield pd.DataFrame({"bucket": np.flatnonzero(n), "n": n[n > 0]})
        give_back()

    out = np.zeros(BUCKETS, np.int64)
    for r in texts.mapInPandas(total, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(docs: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of how much likelier a bucket is in the target, with one added to each count."""
    above, below = float(docs.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((t + 1) * above / ((s + 1) * below))) for s, t in zip(docs.tolist(), target.tolist())], np.int64)


def weighed(docs: DataFrame, target: DataFrame, *, text: str = "text", target_text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """All rows of docs in the struct ``row`` (of the columns ``keep``, or all), with n_words, n_features and weight."""
    spark = docs.sparkSession
    own, other = only_text(docs, text), only_text(target, target_text)
    vocabulary = frequent_vocabulary(own.unionAll(other))
    model = spark.sparkContext.broadcast((vocabulary, bucket_gains(bucket_totals(own, vocabulary), bucket_totals(other, vocabulary))))

    @F.pandas_udf("n_words long, n_features long, weight long")
    def weigh(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        vocabulary, gains = model.value
        for part in parts:
            out = []
            for words in texts_in(pd.DataFrame({"text": part})):
                bucket, of = bucketed(words, vocabulary)
                weight = np.zeros(len(words), np.int64)
                np.add.at(weight, of, gains[bucket])
                out.append(pd.DataFrame({"n_words": [len(w) for w in words], "n_features": np.bincount(of, minlength=len(words)), "weight": weight}))
            yield pd.concat(out, ignore_index=True) if out else pd.DataFrame({"n_words": [], "n_features": [], "weight": []}, dtype="int64")
        give_back()

    row = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)]).alias("row")
    return small_batches(docs).select(row, weigh(F.coalesce(F.col(text), F.lit(""))).alias("w")).select("row", "w.*")


def gumbel(doc_id: Column, seed: str = SEED) -> Column:
    """Noise of a document's id, in thousandths, as a long."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def drawn(rows: DataFrame, *, percent: int = PERCENT, least_words: int = LEAST_WORDS, doc_id: str = "doc_id", seed: str = SEED) -> DataFrame:
    """``weighed`` rows with score and rank: 1, 2, .. for the drawn ones, else null."""
    out = rows.withColumn("score", F.col("weight") + gumbel(F.col(f"row.{doc_id}"), seed)).withColumn("_out", F.col("n_words") < least_words)
    out = staged(out, "scored")
    n, fit = out.agg(F.count(F.lit(1)), F.count_if(~F.col("_out"))).first()
    order = ["_out", F.desc("score"), F.col(f"row.{doc_id}").asc_nulls_last()]
    ranges = max(input_partitions(rows.sparkSession), n // RANGE_ROWS)
    # The id of a row holds its range in the upper and its place in the lower 33 bits.
    placed = staged(out.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranges")
    place, of_range = F.col("_at").bitwiseAND((1 << 33) - 1), F.shiftright("_at", 33)
    sizes = sorted(tuple(r) for r in placed.groupBy(of_range).count().collect())  # one row for each range
    starts = zip((r for r, _ in sizes), accumulate((n for _, n in sizes), initial=0))
    starts = rows.sparkSession.createDataFrame([*starts], "_range long, _start long")
    placed = placed.join(F.broadcast(starts), of_range == F.col("_range"), "left")
    rank = (F.col("_start") + place + 1).cast("long")
    return placed.withColumn("rank", F.when(~F.col("_out") & (rank <= percent * fit // 100), rank)).drop("_out", "_at", "_range", "_start")


def resampled(docs: DataFrame, target: DataFrame, *, text: str = "text", target_text: str = "text", **options) -> DataFrame:
    """The rows of docs that the draw takes, in their own columns."""
    return drawn(weighed(docs, target, text=text, target_text=target_text), **options).where("rank is not null").select("row.*")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    out = drawn(weighed(docs.select("doc_id", "text"), target.select("text"), keep=["doc_id"]))
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_features", "weight", "score", "rank")


STEPS_SQL = "list_reduce([v, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"


def features_sql(name: str, id_: str, texts: str) -> str:
    """CTEs of the words and of the features with their counts of a table."""
    low = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
    return f"""
{name}_words AS (SELECT r, doc_id, regexp_extract_all({low}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM (SELECT row_number() OVER () AS r, {id_} AS doc_id, text FROM {texts})),
{name}_features AS (SELECT r, f, count(*) AS n FROM (
  SELECT r, unnest(w) AS f FROM {name}_words
  UNION ALL SELECT r, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM {name}_words
  UNION ALL SELECT r, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM {name}_words) GROUP BY r, f)"""


OP12_SQL = f"""
WITH steps AS (SELECT list({STEPS_SQL} ORDER BY v) AS s FROM range(256) t(v)),
{features_sql("d", "doc_id", "documents")},
{features_sql("b", "NULL", "benchmark")},
buckets AS (SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(f)), '..'), lambda v: ('0x' || v)::BIGINT)),
    lambda c, v: xor(c >> 8, s[(xor(c, v) & 255) + 1])), 4294967295) % 10000 AS bucket FROM (SELECT f FROM d_features UNION SELECT f FROM b_features), steps),
counts AS (SELECT bucket, coalesce(s, 0) AS s, coalesce(t, 0) AS t FROM (SELECT unnest(range(10000)) AS bucket)
  LEFT JOIN (SELECT bucket, sum(n) AS s FROM d_features JOIN buckets USING (f) GROUP BY bucket) USING (bucket)
  LEFT JOIN (SELECT bucket, sum(n) AS t FROM b_features JOIN buckets USING (f) GROUP BY bucket) USING (bucket)),
gains AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM counts),
weights AS (SELECT r, sum(n) AS n_features, sum(n * gain) AS weight FROM d_features JOIN buckets USING (f) JOIN gains USING (bucket) GROUP BY r),
scored AS (SELECT d.r, doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM d_words d LEFT JOIN weights USING (r)),
ranked AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score, CASE WHEN place <= 5 * n // 100 THEN place END::BIGINT AS rank FROM scored LEFT JOIN ranked USING (r)"""
