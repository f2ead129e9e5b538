"""Language ID with spans (operator 6).

Learning: character trigrams of words are counted per language on a sample of labelled documents of stated size, and
the most frequent ones kept, so the model is bounded. Prediction: a word's script, by ranges of code points, narrows the
languages to those that were seen in it; its trigrams score it under each of those; Viterbi with a penalty for
switching labels the words of a text, and runs of one label are its spans. Distinct words are scored once per worker.

Where the largest gains of the two languages that gain most by a stretch of words over the best single language (a largest-sum
test for each) are no more than the penalty together, that language is the best path and no step-by-step search is needed.
This is exact: of r stretches in other languages, with r - 1 switches or more, neighbours differ in language. One stretch
that isn't the whole text has a switch, and gains no more; of more, each two neighbours gain no more than one penalty, so
with a stretch left over they gain (r + 1) / 2 penalties at most, and cost r - 1.

Defined results: null text, or text without a letter, or nothing to learn from, gives ``und``, score 0 and no spans; rows
with a null doc_id are not held out and not learned from; repeated rows are predicted alike; an empty table gives no
rows; other columns don't matter.
"""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memolake.llm.common import give_back, small_batches, table
from memolake.llm.hashing import blocks

#: Bounds of the model: documents per language, trigrams per language, trigrams of all languages together.
SAMPLE, TRIGRAMS, ALL_TRIGRAMS = 1500, 30_000, 4_000_000
SWITCH = 10.0
#: Words, and scores of words, that a task keeps.
KEEP_WORDS, KEEP_SCORES = 100_000, 4_000_000
#: So many ids are broadcast; more are joined by a shuffle.
FEW_IDS = 1_000_000
#: Of a language's words, the share in a script from which on it is a candidate for that script.
SCRIPT_SHARE = 0.01

#: First code points of ranges and their scripts, up to the next.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0900, "devanagari"),
    (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"),
    (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2E80, "han"),
    (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"),
    (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"), (0xFF21, "latin"), (0xFF66, "kana"), (0xFFA0, "other"), (0x20000, "han"), (0x30000, "other"),
]
_STARTS = [a for a, _ in SCRIPTS]
NOT_LETTERS, NOT_LETTERS_OR_END = regex.compile(r"[^\p{L}]+"), regex.compile(r"[^\p{L}\n]+")


def script_of(letter: str) -> str:
    return SCRIPTS[bisect.bisect_right(_STARTS, ord(letter)) - 1][1]


def letters(word: str) -> str:
    return NOT_LETTERS.sub("", word.lower())


def code(gram: str) -> int:
    return ord(gram[0]) << 42 | ord(gram[1]) << 21 | ord(gram[2])


def trigrams(word: str) -> list[str]:
    w = f"<{word}>"
    return [w[i : i + 3] for i in range(len(w) - 2)]


def crc_remainder(doc_id: str, of: int):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % of


class Model:
    """Languages, trigram log probabilities as sparse rows, and candidate languages by script."""

    def __init__(self, counts: dict, scripts: dict):
        self.languages = sorted(counts)
        pairs = np.array([(code(g), j, n) for j, x in enumerate(self.languages) for g, n in counts[x].items()], np.int64).reshape(-1, 3)
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
        self.codes, first = np.unique(pairs[:, 0], return_index=True)
        self.first = np.append(first, len(pairs))
        self.of = pairs[:, 1].astype(np.int32)
        # A trigram's score is that of an unseen one, and what its count adds.
        total = np.bincount(self.of, pairs[:, 2], len(self.languages)) + 0.5 * (len(self.codes) + 1)
        self.unseen = np.log(0.5 / total)
        self.more = np.log(pairs[:, 2] / 0.5 + 1).astype(np.float32)
        sums = {x: sum(s.values()) or 1 for x, s in scripts.items()}
        self.allowed = {s: np.array([scripts.get(x, {}).get(s, 0) / sums.get(x, 1) >= SCRIPT_SHARE for x in self.languages]) for s in {s for _, s in SCRIPTS}}

    def score(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A row for each word, 0 for all languages where it has no letter, and the words' numbers of letters. Languages
        out of a word's script get the least. Words are taken as one string of code points."""
        clean = NOT_LETTERS_OR_END.sub("", "\n".join(words).lower()).split("\n")
        sizes = np.fromiter(map(len, clean), np.int64, len(clean))
        points = np.frombuffer("".join(f"<{w}>" for w in clean).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        out = np.zeros((len(words), len(self.languages)), np.float32)
        full = np.flatnonzero(sizes)
        if not len(full) or not self.languages:
            return out, sizes
        starts = np.cumsum(sizes + 2) - (sizes + 2)
        # A word of n letters has n trigrams, from its opening mark on.
        codes = points[:-2] << 42 | points[1:-1] << 21 | points[2:]
        at = np.repeat(starts[full] - (np.cumsum(sizes[full]) - sizes[full]), sizes[full]) + np.arange(sizes.sum())
        codes = codes[at]
        out[full] = sizes[full, None] * self.unseen
        row = np.minimum(np.searchsorted(self.codes, codes), max(len(self.codes) - 1, 0))
        seen = np.flatnonzero(self.codes[row] == codes) if len(self.codes) else np.zeros(0, np.int64)
        row, word = row[seen], np.repeat(full, sizes[full])[seen]
        times = self.first[row + 1] - self.first[row]
        at = np.repeat(self.first[row] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        out += np.bincount(np.repeat(word, times) * len(self.languages) + self.of[at], self.more[at], out.size).reshape(out.shape)
        script = np.searchsorted(_STARTS, points[starts[full] + 1], "right") - 1
        for i in np.unique(script):
            allowed = self.allowed[SCRIPTS[i][1]]
            if allowed.any() and not allowed.all():
                these = full[script == i]
                least = np.minimum(out[these].min(1), 0) - 2 * SWITCH
                out[np.ix_(these, np.flatnonzero(~allowed))] = least[:, None]
        return out, sizes


def learned(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, keep: int = TRIGRAMS) -> Model:
    """A model of all languages that docs name, of each at most ``sample`` documents (by hash of the id) and ``keep``
    trigrams, fewer where there are so many languages that all would have more than ALL_TRIGRAMS."""
    d = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).dropna()
    ids = d.select("id", "lang").distinct()
    sizes = ids.groupBy("lang").count()
    many = sizes.count()
    # Of a frequent language only ids of small hash go on to be ranked: about four times as many as are wanted.
    spread = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 20)) * F.col("count")
    ids = ids.join(F.broadcast(sizes) if many <= FEW_IDS else sizes, "lang").where(spread < F.lit(4 * sample * (1 << 20)))
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    ids = ids.withColumn("rank", F.row_number().over(by_hash))
    chosen = ids.where(F.col("rank") <= sample).select(F.col("id"), F.col("lang").alias("of"))
    d = d.join(F.broadcast(chosen) if many * sample <= FEW_IDS else chosen, "id").where("lang = of")  # at most languages * sample ids
    keep = max(1, min(keep, ALL_TRIGRAMS // max(many, 1)))
    d = d.groupBy("id", "lang").agg(F.min("text").alias("text"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams, scripts = {}, {}
        for batch in batches:
            for of, t in zip(batch["lang"], batch["text"]):
                words = Counter(w for x in t.split() if (w := letters(x)))
                g, s = grams.setdefault(of, Counter()), scripts.setdefault(of, Counter())
                for w, n in words.items():
                    s[script_of(w[0])] += n
                    for x in trigrams(w):
                        g[x] += n
        rows = [(x, kind, k, n) for kind, of in (("gram", grams), ("script", scripts)) for x, c in of.items() for k, n in c.items()]
        yield pd.DataFrame(rows, columns=["lang", "kind", "item", "n"])

    counted = d.select("lang", "text").mapInPandas(count, "lang string, kind string, item string, n long").groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))
    most = Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "item")
    counts, scripts = {}, {}
    for r in counted.withColumn("rank", F.row_number().over(most)).where(F.col("rank") <= keep).select("lang", "kind", "item", "n").toPandas().itertuples(index=False):
        (counts if r.kind == "gram" else scripts).setdefault(r.lang, {})[r.item] = r.n
    return Model(counts, scripts)


def viterbi(s: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best language of each word."""
    n, k = s.shape
    best = int(s.sum(0).argmax())
    gain = np.cumsum(s - s[:, [best]], axis=0, dtype=np.float64)
    low = np.minimum.accumulate(np.concatenate((np.zeros((1, k)), gain[:-1])), axis=0)
    if np.sort((gain - low).max(0))[-2:].sum() <= switch:
        return np.full(n, best)
    # Step by step: stay in a language, or come from the best one at the price of a switch. For a few languages plain
    # numbers are faster than arrays.
    v, trail = s[0].tolist(), []
    for row in s[1:].tolist():
        top = max(v)
        jump = top - switch
        trail.append((v, jump, top))
        v = [(x if x >= jump else jump) + y for x, y in zip(v, row)]
    path = np.empty(n, np.int64)
    at = path[-1] = v.index(max(v))
    for t in range(n - 2, -1, -1):
        v, jump, top = trail[t]
        if v[at] < jump:
            at = v.index(top)
        path[t] = at
    return path


SPANS = "lang_pred string, score double, spans array<struct<lang: string, first_word: int, n_words: int>>"


class Labeller:
    def __init__(self, model: Model, switch: float):
        self.model, self.switch = model, switch
        self.clear()

    def clear(self):
        self.known, self.rows, self.sizes = {}, np.zeros((0, len(self.model.languages)), np.float32), np.zeros(0, np.int64)

    def label(self, texts: list[str]) -> list[tuple]:
        if len(self.known) > min(KEEP_WORDS, KEEP_SCORES // max(len(self.model.languages), 1)):
            self.clear()
        split = [t.split() for t in texts]
        words = [w for s in split for w in s]
        at = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        if len(lost := np.flatnonzero(at < 0)):
            new = [*dict.fromkeys(words[i] for i in lost)]
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            few = max(1, KEEP_SCORES // max(len(self.model.languages), 1))
            scored = [self.model.score(new[i : i + few]) for i in range(0, len(new), few)]
            self.rows, self.sizes = (np.concatenate((old, *parts)) for old, parts in zip((self.rows, self.sizes), zip(*scored)))
            at[lost] = [self.known[words[i]] for i in lost]
        out, begin = [], 0
        for s in split:
            mine = at[begin : begin + len(s)]
            begin += len(s)
            sizes = self.sizes[mine]
            if not sizes.sum() or not self.model.languages:
                out.append(("und", 0.0, []))
                continue
            scores = self.rows[mine]
            path = viterbi(scores, self.switch)
            share = np.bincount(path, sizes, len(self.model.languages))
            best = int(share.argmax())
            # How sure: the mean lead per letter over the next best language where the text is in this one.
            own = scores[path == best].sum(0, dtype=np.float64)
            lead = (np.delete(own[best] - own, best).min() if len(own) > 1 else np.inf) / max(share[best], 1)
            sure = 1 / (1 + np.exp(-8 * np.clip(lead, -4, 4)))
            edges = np.flatnonzero(np.diff(path)) + 1
            starts = np.concatenate(([0], edges))
            spans = [(self.model.languages[path[a]], int(a), int(b - a)) for a, b in zip(starts, np.append(edges, len(path)))]
            out.append((self.model.languages[best], float(share[best] / sizes.sum() * sure), spans))
        return out


def with_language(docs: DataFrame, model: Model, *, text: str = "text", out: str = "language", switch: float = SWITCH) -> DataFrame:
    """docs and a struct of SPANS."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by ALL_TRIGRAMS

    @F.pandas_udf(SPANS)
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        labeller = Labeller(shared.value, switch)
        for batch in batches:
            texts = batch.fillna("").tolist()
            rows = [r for a, b in blocks(texts) for r in labeller.label(texts[a:b])]
            yield pd.DataFrame({"lang_pred": [r[0] for r in rows], "score": [r[1] for r in rows], "spans": [[{"lang": x, "first_word": a, "n_words": n} for x, a, n in r[2]] for r in rows]})
        del labeller
        give_back()

    return small_batches(docs).withColumn(out, label(F.col(text)))


def training_rows(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    return docs.where(crc_remainder(doc_id, 3) != 1)


def recognised(docs: DataFrame) -> DataFrame:
    """docs without those of which no language is recognised: null texts and texts without a letter."""
    model = learned(training_rows(docs))
    return with_language(docs, model, out="_language").where(F.col("_language.lang_pred") != "und").select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learned(training_rows(docs))
    out = with_language(docs.select("doc_id", "text"), model)
    held = F.coalesce(crc_remainder("doc_id", 3) == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "language.lang_pred", "language.score")
