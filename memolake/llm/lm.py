"""LM scoring by a hashed maximum-entropy model (operator 8).

Words are known by 64-bit hashes. Frequent words (a bounded number) have classes: the most frequent ones one each, the
others in bins of equal mass; all other words, and the unknown one, form the last class. The probability of a token is
that of its class, a softmax over hashed features of the words before it (one, two, and skips over one and two words),
times that of the word in its class: its share of the class's training tokens. In the last class, counts are discounted
and the unknown word gets what is taken off, so all outcomes (vocabulary and one unknown) sum to one.

Training: in each round every task runs gradient steps over its part of that round's documents from the same
parameters, and the changes, weighted by tokens, are averaged: first over salts, then over all tasks, by blocks of the
parameter table. Rounds split the training documents, so that together they are all gone over once.

Counts of the frequent words are broadcast (bounded); the rare words of each document are joined to the full table of
counts, so memory doesn't grow with the vocabulary.

Defined results: null text is empty and has only the end token; rows with a null doc_id are not held out and not learned
from; repeated rows are scored alike; nothing to learn from gives base scores of an empty vocabulary; an empty table
gives no rows; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memolake.llm import hashing
from memolake.llm.common import staged, table

FREQUENT, MIN_COUNT, OWN, BINS = 65_536, 3, 31, 16
BUCKETS, ROUNDS, RATE, BATCH = 1 << 14, 3, 0.15, 4096
BLOCK_ROWS, SALTS = 1024, 16
END = np.uint64(1)
SKIPS = ((1,), (1, 2), (2,), (3,))
LN10 = float(np.log(10))


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' words, each text's followed by the end token; where texts begin, and the end."""
    h, at = hashing.words(texts)
    ends = at[1:]
    return np.insert(h, ends, END), at + np.arange(len(at))


@dataclass
class Frequent:
    """Frequent words by ascending hash, with counts, classes and shares; totals; how the last class is shared out."""

    words: np.ndarray
    counts: np.ndarray
    classes: np.ndarray
    log_share: np.ndarray
    class_log: np.ndarray
    total: int
    distinct: int
    rare_total: int
    rare_distinct: int
    discount: float

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.total + 0.5 * (self.distinct + 1)))

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each word among the frequent ones, or -1."""
        if not len(self.words):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return np.where(self.words[at] == h, at, -1)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c): how often each word stands in all texts, added up per batch before the shuffle."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            for a, b in hashing.blocks(texts, 8_000_000):
                parts = [np.unique(tokens(texts[a:b][i:j])[0], return_counts=True) for i, j in hashing.blocks(texts[a:b])]
                w, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                yield pd.DataFrame({"word": w.astype(np.int64), "c": np.bincount(where, np.concatenate([p[1] for p in parts])).astype(np.int64)})

    return docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInPandas(count, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


def frequent_words(counts: DataFrame, most: int = FREQUENT) -> Frequent:
    row = counts.agg(F.count(F.lit(1)).alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.when(F.col("c") == 1, 1)).alias("n1"), F.count(F.when(F.col("c") == 2, 1)).alias("n2")).first()
    # Bands of counts, eight to each doubling, from the top as long as their words are no more than ``most``.
    band = F.floor(F.log2(F.col("c").cast("double")) * 8)
    enough = counts.where(F.col("c") >= MIN_COUNT)
    held, least = 0, None
    for r in enough.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("band")).collect():  # some hundred rows
        held += r["n"]
        if held > most:
            break
        least = r["band"]
    top = enough.where(band >= least if least is not None else F.lit(False)).toPandas()
    top = top.sort_values(["c", "word"], ascending=[False, True], ignore_index=True)
    c = top["c"].to_numpy(np.int64)
    own = np.minimum(np.arange(len(c)), OWN)
    rest = c[OWN:].cumsum()
    classes = own.copy()
    if len(rest):
        classes[OWN:] = OWN + np.minimum((rest - c[OWN:]) * BINS // rest[-1], BINS - 1)
    last = OWN + BINS
    rare_total, rare_distinct = int(row["n"] - c.sum()), int(row["v"] - len(c))
    mass = np.bincount(classes, c, last + 1)
    mass[last] = rare_total
    discount = (row["n1"] + 0.5) / (row["n1"] + 2 * row["n2"] + 1.0)
    words = top["word"].to_numpy(np.int64).view(np.uint64)
    by = np.argsort(words)
    share = np.log(c / mass[classes]) if len(c) else np.zeros(0)
    return Frequent(words[by], c[by], classes[by], share[by], np.log((mass + 0.5) / (mass.sum() + 0.5 * (last + 1))).astype(np.float32), int(row["n"]), int(row["v"]), rare_total, rare_distinct, float(discount))


def features(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Bucket numbers of each token's features, one column for each of SKIPS; places before a text's begin are 0."""
    first = np.repeat(at[:-1], np.diff(at))
    place = np.arange(len(h))
    back = {k: np.where(place - k >= first, h[np.maximum(place - k, 0)], np.uint64(0)) for k in (1, 2, 3)}
    out = np.empty((len(h), len(SKIPS)), np.int32)
    for j, ks in enumerate(SKIPS):
        x = np.full(len(h), 0x9E3779B97F4A7C15 * (j + 1) & 0xFFFFFFFFFFFFFFFF, np.uint64)
        for k in ks:
            x = hashing.mix(x ^ back[k])
        out[:, j] = (x & np.uint64(BUCKETS - 1)).astype(np.int32)
    return out


def log_softmax(f: np.ndarray, w: np.ndarray, bias: np.ndarray) -> np.ndarray:
    z = w[f[:, 0]]
    for j in range(1, f.shape[1]):
        z += w[f[:, j]]
    z += bias
    z -= z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def steps(f: np.ndarray, y: np.ndarray, w: np.ndarray, bias: np.ndarray, squares: np.ndarray, rate: float) -> None:
    """Gradient steps over the tokens in batches, scaled per bucket by the squares so far; w and squares change."""
    for a in range(0, len(y), BATCH):
        g = np.exp(log_softmax(f[a : a + BATCH], w, bias))
        g[np.arange(len(g)), y[a : a + BATCH]] -= 1
        for j in range(f.shape[1]):
            rows = f[a : a + BATCH, j]
            by = np.argsort(rows, kind="stable")
            start = np.flatnonzero(np.diff(rows[by], prepend=-1))
            total = np.add.reduceat(g[by], start, axis=0)
            at = rows[by][start]
            squares[at] += (total * total).mean(1)
            w[at] -= rate * total / np.sqrt(squares[at] + 1.0)[:, None]


def trained(docs: DataFrame, frequent: Frequent, rounds: int = ROUNDS, rate: float = RATE) -> np.ndarray:
    """The parameter table: BUCKETS rows of one number per class."""
    classes = len(frequent.class_log)
    w = np.zeros((BUCKETS, classes), np.float32)
    context = docs.sparkSession.sparkContext
    d = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.pmod(F.xxhash64("doc_id"), F.lit(rounds)).alias("round"))
    for r in range(rounds):
        shared = context.broadcast((frequent, w))  # a fixed number of parameters, a bounded number of words

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            frequent, begun = shared.value
            w, squares, seen = begun.copy(), np.zeros(BUCKETS, np.float32), 0
            for batch in batches:
                texts = batch["text"].tolist()
                for a, b in hashing.blocks(texts):
                    h, at = tokens(texts[a:b])
                    found = frequent.find(h)
                    y = np.where(found < 0, len(frequent.class_log) - 1, frequent.classes[found] if len(frequent.words) else 0)
                    steps(features(h, at), y, w, frequent.class_log, squares, rate)
                    seen += len(h)
            if seen:
                change = (w - begun) * np.float32(seen)
                part = TaskContext.get().partitionId() % SALTS
                blocks = range(0, BUCKETS, BLOCK_ROWS)
                yield pd.DataFrame({"block": list(blocks), "salt": part, "n": seen, "change": [change[i : i + BLOCK_ROWS].tobytes() for i in blocks]})

        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """Sums per block of what a task has: at most one row for each block is held."""
            sums: dict = {}
            for batch in batches:
                for block, n, change in zip(batch["block"], batch["n"], batch["change"]):
                    x = np.frombuffer(change, np.float32)
                    held = sums.get(block)
                    sums[block] = (n, x.astype(np.float64)) if held is None else (held[0] + n, held[1] + x)
            yield pd.DataFrame({"block": list(sums), "salt": 0, "n": [x[0] for x in sums.values()], "change": [x[1].astype(np.float32).tobytes() for x in sums.values()]})

        schema = "block int, salt int, n long, change binary"
        moved = d.where(F.col("round") == r).mapInPandas(run, schema)
        moved = moved.repartition("block", "salt").mapInPandas(add, schema).repartition("block").mapInPandas(add, schema)
        for row in moved.collect():  # BUCKETS / BLOCK_ROWS rows of fixed size
            if row["n"]:
                w[row["block"] : row["block"] + BLOCK_ROWS] += (np.frombuffer(row["change"], np.float32) / np.float32(row["n"])).reshape(-1, classes)
    return w


PARTS = "row long, doc_id long, n_tokens long, n_known long, base double, score double, words array<long>, times array<int>"


def scored(docs: DataFrame, counts: DataFrame, frequent: Frequent, w: np.ndarray) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) for each row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast((frequent, w))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frequent, w = shared.value
        last = len(frequent.class_log) - 1
        row = (TaskContext.get().partitionId() << 33) - 1
        base_of = frequent.base(frequent.counts)
        for batch in batches:
            texts, names, out = batch["text"].tolist(), batch["doc_id"].tolist(), []
            for a, b in hashing.blocks(texts):
                h, at = tokens(texts[a:b])
                found = frequent.find(h)
                known = found >= 0
                f = features(h, at)
                y = np.full(len(h), last)
                own, base = np.zeros(len(h)), np.zeros(len(h))
                y[known], own[known], base[known] = frequent.classes[found[known]], frequent.log_share[found[known]], base_of[found[known]]
                for i in range(0, len(h), BATCH):
                    z = log_softmax(f[i : i + BATCH], w, frequent.class_log)
                    own[i : i + BATCH] += z[np.arange(len(z)), y[i : i + BATCH]]
                sums = [np.add.reduceat(x, at[:-1]) for x in (known.astype(np.int64), base, own)]
                for i in range(b - a):
                    words, times = np.unique(h[at[i] : at[i + 1]][~known[at[i] : at[i + 1]]], return_counts=True)
                    row += 1
                    out.append((row, names[a + i], at[i + 1] - at[i], sums[0][i], sums[1][i], sums[2][i] / LN10, words.astype(np.int64), times.astype(np.int32)))
            frame = pd.DataFrame(out, columns=["row", "doc_id", "n_tokens", "n_known", "base", "score", "words", "times"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = staged(d.mapInPandas(score, PARTS), "lm-parts")
    pairs = parts.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").cast("long").alias("times"))
    c = F.coalesce("c", F.lit(0))
    base = F.log10((c + 0.5) / F.lit(frequent.total + 0.5 * (frequent.distinct + 1)))
    total = max(frequent.rare_total, 1)
    unknown = max(frequent.discount * frequent.rare_distinct / total, 1e-12) if frequent.rare_total else 1.0
    own = F.when(c > 0, F.log10((c - frequent.discount) / F.lit(float(total)))).otherwise(F.lit(float(np.log10(unknown))))
    rare = pairs.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.when(c > 0, F.col("times")).otherwise(F.lit(0))).alias("rare_known"), F.sum(F.col("times") * base).alias("rare_base"), F.sum(F.col("times") * own).alias("rare_score"),
    )
    zero = lambda x: F.coalesce(F.col(x), F.lit(0))
    return parts.select("row", "doc_id", "n_tokens", "n_known", "base", "score").join(rare, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + zero("rare_known")).alias("n_known"), F.lit(frequent.total).cast("long").alias("train_tokens"),
        (F.col("base") + zero("rare_base")).alias("base_score"), (F.col("score") + zero("rare_score")).alias("score"),
    )


def fitted(docs: DataFrame) -> tuple[DataFrame, Frequent, np.ndarray]:
    """Counts, frequent words and parameters of the model of docs (doc_id, text)."""
    counts = staged(word_counts(docs), "word-counts")
    frequent = frequent_words(counts)
    return counts, frequent, trained(docs, frequent)


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    counts, frequent, w = fitted(docs.where(remainder != 1))
    out = scored(docs, counts, frequent, w)
    return out.select("doc_id", F.coalesce(remainder == 1, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
