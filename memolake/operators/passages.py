"""Passages: the part of a document that answers, what it is worth, and plans of pieces for an embedder."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memolake.operators import fusion, vector
from memolake.tables import little

RADIUS, WIDTH, EVIDENCE = 160, 1200, 420
FEW = 1_000_000


def starts(text: str, piece: str) -> np.ndarray:
    """All places of a piece in a text, overlaps too."""
    out, at = [], text.find(piece)
    while at >= 0 and piece:
        out.append(at)
        at = text.find(piece, at + 1)
    return np.array(out, np.int64)


def lowered(text: str) -> str:
    """Lower case with all places kept: letters whose lower case is longer stay as they are."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def window_worth(text: str, words: list[tuple[float, list[str]]], width: int = WIDTH) -> float:
    """words: (idf, terms). The most that words with a term's start in one window are worth: each place is tried as the last
    start of its window, and a word counts if its last start up to there isn't further back than the width."""
    low = (text or "").lower()
    of_word = [np.sort(np.concatenate([starts(low, g.lower()) for g in terms] or [np.zeros(0, np.int64)])) for _, terms in words]
    ends = np.unique(np.concatenate(of_word or [np.zeros(0, np.int64)]))
    if not len(ends):
        return 0.0
    worth = np.zeros(len(ends))
    for (idf, _), at in zip(words, of_word):
        if len(at):
            last = np.searchsorted(at, ends, "right") - 1
            worth += idf * ((last >= 0) & (at[np.maximum(last, 0)] >= ends - width))
    return float(worth.max())


def best_window(text: str, words: list[tuple[float, list[str]]], lo: int, hi: int, width: int, empty: str) -> tuple[int, int, str]:
    """(start, end, rule) of the earliest window of at most ``width`` characters in text[lo:hi] whose words, each with a term
    wholly inside, are worth most; without a word the region's middle (``centre``) or its start."""
    low, span = lowered(text)[lo:hi], min(width, hi - lo)
    found = [(i, len(g), lo + starts(low, g.lower())) for i, (_, terms) in enumerate(words) for g in terms]
    found = [x for x in found if len(x[2])]
    # Windows that begin with a term, end with one, or begin with the region; without a term the only one is the empty rule's.
    opening = [lo if found or empty != "centre" else lo + (hi - lo - span) // 2]
    tries = np.unique(np.concatenate([opening, *[np.clip(np.concatenate((at, at + n - span)), lo, hi - span) for _, n, at in found]]).astype(np.int64))
    holds = np.zeros((len(words), len(tries)), bool)
    for i, n, at in found:
        after = np.searchsorted(at, tries)
        holds[i] |= (after < len(at)) & (at[np.minimum(after, len(at) - 1)] + n <= tries + span)
    first = int(tries[np.argmax(np.round(np.array([w for w, _ in words]) @ holds, 9))]) if found else opening[0]
    return first, first + span, "words" if found else "short-" * (span < width or hi - lo == width) + empty


def excerpt_of(body: str, words: list[str], radius: int = RADIUS) -> str:
    """One line around the first place of that word, of all first places, which has most words wholly within the radius; the
    head if no word is there. Dots where text is left out before it, and after it."""
    low = body.lower()
    at = [(len(w), starts(low, w.lower())) for w in words]
    firsts = np.array([p[0] for _, p in at if len(p)], np.int64)
    if not len(firsts):
        return " ".join(body[: 2 * radius].split())
    lows, highs = np.maximum(firsts - radius, 0), np.minimum(firsts + radius, len(low))
    within = sum((np.append(p, len(low) + 1)[np.searchsorted(p, lows)] + n <= highs).astype(int) for n, p in at)
    place = int(firsts[np.argmax(within)])
    begin = max(place - radius, 0)
    return " ".join(("…" * (begin > 0) + body[begin : place + radius] + "…").split())


def query_words(chosen: DataFrame) -> DataFrame:
    """(qid, words): each query's words as (idf, terms), of chosen grams (qid, word, gram, word_idf)."""
    word = chosen.groupBy("qid", "word").agg(F.first("word_idf").alias("idf"), F.array_sort(F.collect_set("gram")).alias("terms"))
    return word.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("word", "idf", "terms"))).alias("words"))


def _pairs(words) -> list[tuple[float, list[str]]]:
    return [(w["idf"], list(w["terms"])) for w in (words if words is not None else [])]


def with_words(pool: DataFrame, docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """pool (qid, doc_id, ..) with the words of the query and the text of the document."""
    text = F.concat_ws("\n", "title", "description", "body")
    d = docs.select("doc_id", "body", text.alias("text")).join(little(pool, FEW), "doc_id")
    return d.join(little(query_words(chosen), FEW), "qid", "left")


def worths(pool: DataFrame, docs: DataFrame, chosen: DataFrame, width: int = WIDTH) -> DataFrame:
    """(qid, doc_id, worth) of the rows of a pool: see window_worth."""

    def value(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"qid": b["qid"], "doc_id": b["doc_id"], "worth": [window_worth(t, _pairs(w), width) for t, w in zip(b["text"], b["words"])]})

    d = with_words(pool.select("qid", "doc_id").distinct(), docs, chosen).select("qid", "doc_id", "text", "words")
    return d.mapInPandas(value, f"qid {_type(d, 'qid')}, doc_id {_type(d, 'doc_id')}, worth double")


def _type(d: DataFrame, column: str) -> str:
    return d.schema[column].dataType.simpleString()


def excerpts(pool: DataFrame, docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(qid, doc_id, excerpt): the text around the place that has most of the query's words near, else the head."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"qid": b["qid"], "doc_id": b["doc_id"], "excerpt": [excerpt_of(t or "", [x["word"] for x in (w if w is not None else [])]) for t, w in zip(b["body"], b["words"])]})

    d = with_words(pool.select("qid", "doc_id").distinct(), docs, chosen).select("qid", "doc_id", "body", "words")
    return d.mapInPandas(cut, f"qid {_type(d, 'qid')}, doc_id {_type(d, 'doc_id')}, excerpt string")


def evidence(pool: DataFrame, docs: DataFrame, chosen: DataFrame, width: int = EVIDENCE, chunk: int = 1200, step: int = 1000) -> DataFrame:
    """(qid, doc_id, chunk_no, start, end, rule, passage) of pool (qid, doc_id, chunk_no): the best window inside the chunk that
    matched, or, where that is null, in the whole body; places are in the body without blanks at its ends."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for qid, doc, no, body, w in zip(b["qid"], b["doc_id"], b["chunk_no"], b["body"], b["words"]):
                t = (body or "").strip()
                whole = pd.isna(no)
                lo, hi = (0, len(t)) if whole else (int(no) * step, min(int(no) * step + chunk, len(t)))
                if whole or lo < len(t):
                    s, e, rule = best_window(t, _pairs(w), lo, hi, width, "start" if whole else "centre")
                    out.append((qid, doc, None if whole else int(no), s, e, rule, t[s:e]))
            yield pd.DataFrame(out, columns=["qid", "doc_id", "chunk_no", "start", "end", "rule", "passage"])

    d = with_words(pool.select("qid", "doc_id", "chunk_no"), docs, chosen).select("qid", "doc_id", "chunk_no", "body", "words")
    return d.mapInPandas(find, f"qid {_type(d, 'qid')}, doc_id {_type(d, 'doc_id')}, chunk_no int, start int, end int, rule string, passage string")


# Fixed value: how an embedder is given a passage.
PROMPT = "title: {} | text: {}"
#: Where a text may be cut, the best places first: after a paragraph, a line, a sentence.
BREAKS = [re.compile(rx) for rx in (r"\n\s*\n", r"\n", r"[.!?]\s+")]
#: A piece has at most so many characters for each token of the budget.
REACH = 8


def prompt(text: str, title: str) -> str:
    return PROMPT.format(title or "none", text)


def pieces_of(text: str, title: str, count: Callable[[str], int], budget: int) -> list[tuple[int, int, int, str]]:
    """(start, end, tokens, hash) of pieces that cover the text without overlap, each of at most ``budget`` tokens with its
    prompt, cut after a paragraph, else a line, else a sentence, where one ends in the piece's second half. A title is
    halved until it takes half of the budget at most. count is taken to grow with the text."""
    halves = (title[: len(title) >> k] for k in range(len(title).bit_length() + 1))
    title = next((t for t in halves if count(prompt("", t)) <= budget // 2), "")
    breaks = [np.array([m.end() for m in rx.finditer(text)], np.int64) for rx in BREAKS]
    cuts = [0]
    while cuts[-1] < len(text):
        begin = cuts[-1]
        reach = min(REACH * budget, len(text) - begin)
        # As many characters as fit: the first count that is too high comes after them.
        most = bisect_left(range(1, reach + 1), True, key=lambda n: count(prompt(text[begin : begin + n], title)) > budget)
        if not most:
            raise ValueError("the budget has no room for the prompt and a character")
        last = [int(b[i - 1]) for b in breaks if (i := np.searchsorted(b, begin + most, "right"))]
        good = [e for e in last if e - begin >= max(1, most // 2)] if begin + most < len(text) else []
        cuts.append(good[0] if good else begin + most)
    whole = [prompt(text[a:b], title) for a, b in pairwise(cuts)]
    return [(a, b, count(w), hashlib.sha256(w.encode()).hexdigest()) for (a, b), w in zip(pairwise(cuts), whole)]


def token_plan(docs: DataFrame, counter: Callable[[], Callable[[str], int]], budget: int = 768) -> DataFrame:
    """(doc_id, piece_no, start, end, tokens, input_hash) of docs (doc_id, title, body). counter makes, once in each task, the
    function that counts a text's tokens."""

    def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter()
        for b in batches:
            rows = [(d, i, *p) for d, title, body in zip(b["doc_id"], b["title"], b["body"]) for i, p in enumerate(pieces_of(body or "", title or "", count, budget))]
            yield pd.DataFrame(rows, columns=["doc_id", "piece_no", "start", "end", "tokens", "input_hash"])

    return docs.select("doc_id", "title", "body").mapInPandas(plan, f"doc_id {_type(docs, 'doc_id')}, piece_no int, start int, end int, tokens int, input_hash string")


def pool_of(words: DataFrame, meaning: DataFrame, depth: int = 20) -> DataFrame:
    """(qid, doc_id, w, m, base): documents of both lanes' firsts with their ranks from 0, ``depth`` where a lane lacks them;
    base: the order of the words' lane, then the meaning's."""
    w = words.where(F.col("rank") <= depth).select("qid", "doc_id", (F.col("rank") - 1).alias("w"))
    m = meaning.where(F.col("rank") <= depth).select("qid", "doc_id", (F.col("rank") - 1).alias("m"))
    d = w.join(m, ["qid", "doc_id"], "full_outer")
    base = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("w").asc_nulls_last(), "m")) - 1
    return d.withColumn("base", base).select("qid", "doc_id", F.coalesce("w", F.lit(depth)).alias("w"), F.coalesce("m", F.lit(depth)).alias("m"), "base")


def ranked_by_worth(pool: DataFrame, worth: DataFrame) -> DataFrame:
    """pool with ``passage``, the place from 0 by worth, then by base."""
    d = pool.join(worth, ["qid", "doc_id"], "left").withColumn("worth", F.coalesce("worth", F.lit(0.0)))
    return d.withColumn("passage", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(F.round("worth", 9)), "base")) - 1)


def three_lanes(pool: DataFrame, worth: DataFrame, k: int, factor: DataFrame | None = None, depth: int = 20) -> DataFrame:
    """(qid, doc_id, score, rank): words, meaning and passage by reciprocal rank (k = 60), times the priority factor
    (doc_id, factor); ties in the order of the pool."""
    d = ranked_by_worth(pool, worth)
    lane = lambda c: F.when(F.col(c) < depth, F.lit(1.0) / (fusion.RRF_K + 1 + F.col(c))).otherwise(0.0)
    score = lane("w") + lane("m") + F.lit(1.0) / (fusion.RRF_K + 1 + F.col("passage"))
    d = d.withColumn("score", score)
    if factor is not None:
        d = d.join(factor, "doc_id", "left").withColumn("score", F.col("score") * F.coalesce("factor", F.lit(1.0)))
    place = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "base")
    return d.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("qid", "doc_id", "score", "rank")


def better_of_lanes(pool: DataFrame, worth: DataFrame, k: int, factor: DataFrame | None = None) -> DataFrame:
    """(qid, doc_id, rank): by the better of both ranks over the priority factor, then the passage, then the ranks' sum, then the
    words' rank; a factor of 0 comes last."""
    d = ranked_by_worth(pool, worth)
    d = d.withColumn("factor", F.lit(1.0)) if factor is None else d.join(factor, "doc_id", "left").withColumn("factor", F.coalesce("factor", F.lit(1.0)))
    best = F.when(F.col("factor") == 0, F.lit(float("inf"))).otherwise((F.least("w", "m") + 1) / F.col("factor"))
    place = Window.partitionBy("qid").orderBy(F.round(best, 9), "passage", F.col("w") + F.col("m"), "w")
    return d.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("qid", "doc_id", "rank")


def neighbours(pool: DataFrame, meaning: DataFrame, edges: DataFrame, seeds: int = 3) -> DataFrame:
    """(qid, doc_id): documents linked, either way, with a query's first meaning hits that the pool doesn't have."""
    both = edges.select("src", "dst").union(edges.select("dst", "src")).distinct()
    seed = meaning.where(F.col("rank") <= seeds).select("qid", F.col("doc_id").alias("src"))
    return both.join(little(seed, FEW), "src").select("qid", F.col("dst").alias("doc_id")).distinct().join(pool.select("qid", "doc_id"), ["qid", "doc_id"], "left_anti")


def linked_arm(pool: DataFrame, near: DataFrame, worth: DataFrame, cos: DataFrame | None = None) -> DataFrame:
    """pool and those of the neighbours (qid, doc_id) that are worth something (worth: qid, doc_id, worth), behind all others (no
    rank in either lane), the nearest first by the cosine of their best chunk (cos: qid, doc_id, cos)."""
    near = near.join(worth.where("worth > 0").select("qid", "doc_id"), ["qid", "doc_id"], "left_semi")
    near = near.withColumn("cos", F.lit(None).cast("double")) if cos is None else near.join(cos.groupBy("qid", "doc_id").agg(F.max("cos").alias("cos")), ["qid", "doc_id"], "left")
    last = pool.groupBy("qid").agg((F.max("base") + 1).alias("_last"))
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc_nulls_last(F.round("cos", 6)), "doc_id"))
    near = near.join(last, "qid").withColumn("base", F.col("_last") + place - 1)
    return pool.unionByName(near.select("qid", "doc_id", F.lit(20).alias("w"), F.lit(20).alias("m"), "base"))


def meaning_top(queries: DataFrame, chunks: DataFrame, allowed: DataFrame, k: int, left_out: DataFrame | None = None, lowest: bool = False) -> DataFrame:
    """(qid, doc_id, chunk_no, cos, rank): each query's first k of the allowed documents (doc_id) by their best chunk, without those left
    out for it (qid, doc_id), as ones shown already; lowest: the farthest, as decoys. Chunks are filtered before they are ranked
    and as many more are ranked as a query leaves out, so all k places are filled if there are so many."""
    most = 0 if left_out is None else left_out.distinct().groupBy("qid").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    top = vector.cosine_top(queries, chunks.join(allowed.select("doc_id").distinct(), "doc_id", "left_semi"), k + most, lowest)
    if left_out is not None:
        top = top.join(left_out.select("qid", "doc_id").distinct(), ["qid", "doc_id"], "left_anti")
    place = Window.partitionBy("qid").orderBy("rank")
    return top.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("qid", "doc_id", "chunk_no", "cos", "rank")


def best_chunks(scored: DataFrame, held: DataFrame, current: DataFrame) -> DataFrame:
    """(qid, doc_id, chunk_no, cos): the best chunk of (qid, doc_id, chunk_no, cos), the lower of equals, of documents whose held
    chunks (doc_id, chunk_no, sha) all have the current content (doc_id, sha) and are numbered from 0 on without a gap."""
    h = held.join(current.select("doc_id", F.col("sha").alias("_now")), "doc_id")
    whole = h.groupBy("doc_id").agg(F.min((F.col("sha") == F.col("_now")).cast("int")).alias("same"), F.count(F.lit(1)).alias("n"), F.countDistinct("chunk_no").alias("d"), F.min("chunk_no").alias("lo"), F.max("chunk_no").alias("hi"))
    whole = whole.where("same = 1 and n = d and lo = 0 and hi = n - 1").select("doc_id")
    place = Window.partitionBy("qid", "doc_id").orderBy(F.desc(F.round("cos", 9)), "chunk_no")
    return scored.join(whole, "doc_id", "left_semi").withColumn("_r", F.row_number().over(place)).where("_r = 1").drop("_r")


def judge_inputs(pool: DataFrame, queries: DataFrame, docs: DataFrame, model: str, head: int = 420, about: int = 160, most: int = 20, scrub: Callable[[Column], Column] | None = None) -> DataFrame:
    """(qid, n, prompt, key): each query's first candidates in one text for a judge, and a hash of model and text. pool (qid,
    doc_id, rank), with the passage as ``excerpt`` or else the body's head."""
    d = pool.where(F.col("rank") <= most).join(docs.select("doc_id", "name", "description", "body"), "doc_id")
    excerpt = F.substring(F.col("excerpt") if "excerpt" in pool.columns else F.trim("body"), 1, head)
    clean = (lambda c: c) if scrub is None else scrub
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), "name", F.lit(" — "), clean(F.substring(F.coalesce("description", F.lit("")), 1, about)), F.lit("\n"), clean(excerpt))
    lines = d.select("qid", "rank", line.alias("line")).groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n\n").alias("lines"))
    out = queries.select("qid", "text").join(lines, "qid").withColumn("prompt", F.concat(F.lit("Question: "), clean(F.col("text")), F.lit("\n\n"), "lines"))
    return out.select("qid", "n", "prompt", F.sha2(F.concat(F.lit(model), F.lit("␟"), "prompt"), 256).alias("key"))


def answered(wanted: DataFrame, cache: DataFrame, ask: Callable[[list[str]], list], column: str, result: str, batch: int = 20) -> DataFrame:
    """cache (key, answer) and the answers to what it lacks: equal keys are asked once, in batches, by the caller's function
    from a list of texts to a list of results of that type. For judges and embedders alike."""
    lacking = wanted.select("key", column).dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), batch):
                part = b.iloc[i : i + batch]
                yield pd.DataFrame({"key": part["key"], "answer": list(ask(part[column].tolist()))})

    return cache.select("key", "answer").unionByName(lacking.mapInPandas(call, f"key string, answer {result}"))
