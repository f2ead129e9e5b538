"""Periodic runs of words and their collapse (operator 11): an online, sparse DP over diagonals.

A diagonal is a lag q; its match length grows while a word equals the one q before it and ends where it doesn't. Words go
by in order, each adds one to the diagonals of its earlier occurrences, and a diagonal that ends with enough words is a
run at once. Followed word by word that is quadratic in the repeats of a frequent word, so the diagonals are kept sparse
without losing one: for lags in (b/2, b] an occurrence is one of the whole block of b words that ends here. A run has
4q words or more, so blocks inside it are at least a period long and its smallest period is the distance of a block to its
nearest earlier occurrence (farther ones are multiples): each word adds to one diagonal per block size. Blocks of 2b words
are named by the names of their two halves, and only places in long enough stretches of repeated blocks go on to the next
size. Work is O(n log n) for any text, and little more than naming the words for one without repetition.

Names are exact (no hashes). One text is one task's, as its runs may be as long as itself; no two texts ever meet.

Defined results: a null or empty text has no words, no runs and an empty collapse; null and repeated ids are rows of their
own; an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memolake.llm.common import WORD, give_back, small_batches, table
from memolake.llm.hashing import blocks

#: A run has so many words at least, and its period so many times.
LEAST_WORDS, LEAST_TIMES = 6, 4
RUNS = "array<struct<start:long, length:long, period:long>>"


def closed_diagonals(at: np.ndarray, lag: np.ndarray, block: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of one block size, from places in order and the lag that each adds to."""
    runs, q, last, steps = [], 0, -2, 0
    for i, found in zip([*at.tolist(), -2], [*lag.tolist(), 0]):
        if found == q and i == last + 1:
            steps += 1
        else:
            length = steps + block - 1 + q
            if q and length >= max(LEAST_WORDS, LEAST_TIMES * q):
                runs.append((last - length + 1, length, q))
            q, steps = found, 1
        last = i
    return runs


def in_stretches(at: np.ndarray, least: int) -> np.ndarray:
    """Which of the ascending places belong to stretches of so many consecutive ones."""
    if not len(at):
        return np.zeros(0, bool)
    ends = np.flatnonzero(np.concatenate((np.diff(at) != 1, [True])))
    sizes = np.diff(np.concatenate(([-1], ends)))
    return np.repeat(sizes >= least, sizes)


def repeated(at: np.ndarray, keys: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The places whose key stands at another place too, in stretches long enough, and names of their keys."""
    names, found = pd.factorize(keys)
    keep = np.bincount(names, minlength=len(found))[names] > 1
    at, names = at[keep], names[keep]
    keep = in_stretches(at, least)
    return at[keep], names[keep].astype(np.int64)


def runs_of(texts: list[list[bytes]]) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of all texts, by start, then period; words are numbered on through the texts."""
    sizes = np.array([len(t) for t in texts], np.int64)
    n = int(sizes.sum())
    if not n:
        return []
    words = np.empty(n, object)
    words[:] = [w for t in texts for w in t]
    codes, found = pd.factorize(words)
    text = np.repeat(np.arange(len(texts)), sizes)
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    at, names = repeated(np.arange(n), text * len(found) + codes, LEAST_WORDS)
    alike = np.flatnonzero((np.diff(at) == 1) & (np.diff(names) == 0)) + 1
    runs, half = closed_diagonals(at[alike], np.ones(len(alike), np.int64), 1), 1
    held = np.full(n, -1, np.int64)
    while len(at):
        # Blocks of 2 * half words: lags of more than half, so texts of more than four times that.
        held[:] = -1
        held[at] = names
        at = at[(at - half >= first[at]) & (sizes[text[at]] >= LEAST_TIMES * (half + 1))]
        at = at[held[at - half] >= 0]
        if not len(at):
            break
        at, names = repeated(at, held[at - half] * (int(names.max()) + 1) + held[at], 2 * half + 5)
        order = np.argsort(names, kind="stable")
        again = np.flatnonzero(np.diff(names[order]) == 0) + 1
        lag = np.zeros(len(at), np.int64)
        lag[order[again]] = at[order[again]] - at[order[again - 1]]
        near = (lag > half) & (lag <= 2 * half)
        half *= 2
        runs += closed_diagonals(at[near], lag[near], half)
    return sorted(runs, key=lambda r: (r[0], r[2]))


def collapsed(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of each document: its runs by start, then period, and its words joined by one blank
    without those that a run holds after its first period."""
    schema = docs.select(F.col(doc_id).alias("doc_id")).schema.simpleString()[7:-1] + f", n_words long, runs {RUNS}, collapsed string"

    def collapse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a, b in blocks(batch["text"].tolist()):
                texts = [t.encode("utf-8", "surrogatepass").split() for t in batch["text"].iloc[a:b]]
                out = batch[["doc_id"]].iloc[a:b].reset_index(drop=True)
                ends = np.cumsum([len(t) for t in texts])
                found = runs_of(texts)
                runs, gone = [[] for _ in texts], {}
                for (start, length, period), i in zip(found, np.searchsorted(ends, [r[0] for r in found], "right").tolist()):
                    begin = start - int(ends[i]) + len(texts[i])
                    runs[i].append({"start": begin, "length": length, "period": period})
                    gone.setdefault(i, np.zeros(len(texts[i]), bool))[begin + period : begin + length] = True
                for i, drop in gone.items():
                    texts[i] = [w for w, x in zip(texts[i], drop.tolist()) if not x]
                out["n_words"] = np.diff(ends, prepend=0)
                out["runs"] = runs
                out["collapsed"] = [b" ".join(t).decode("utf-8", "surrogatepass") for t in texts]
                yield out
        give_back()

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if dict(rows.dtypes)["doc_id"] in ("tinyint", "smallint", "int", "bigint"):
        # A null id would make the column one of doubles in pandas.
        rows, key = rows.withColumn("doc_id", F.col("doc_id").cast("string")), dict(rows.dtypes)["doc_id"]
        schema = schema.replace(f"doc_id:{key}", "doc_id:string")
        out = small_batches(rows).mapInPandas(collapse, schema)
        return out.withColumn("doc_id", F.col("doc_id").cast(key))
    return small_batches(rows).mapInPandas(collapse, schema)


def made_periodic(doc_id: Column, text: Column) -> Column:
    """The text of every tenth document by its id's hash with its words from some place on repeated from there, else as it is."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n = F.size(words)
    a = (g % n).cast("int")
    p = (F.floor((n - a) / (3 + g % 8)) + 1).cast("int")
    again = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    made = F.array_join(F.slice(F.concat(F.slice(words, F.lit(1), a), again), F.lit(1), n), " ")
    return F.when((h % 10 == 0) & text.rlike(WORD), made).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = collapsed(docs.select("doc_id", made_periodic(F.col("doc_id"), F.col("text")).alias("text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    out = out.withColumn("_best", best)
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_best.start")).alias("start"), F.col("_best.length").alias("length"), (-F.col("_best.period")).alias("period"),
        F.floor(F.col("_best.length") * 1000 / -F.col("_best.period")).alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def crc32_sql(text: str) -> str:
    """DuckDB's expression of the CRC-32 of a text's UTF-8 bytes."""
    step = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    data = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda v: ('0x' || v)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {data}), lambda c, b: {step}), 4294967295)"


OP11_SQL = f"""
WITH texts AS (
  SELECT *, len(w) AS n, h // 10 AS g FROM (
    SELECT row_number() OVER () AS r, doc_id, {crc32_sql("doc_id::VARCHAR")} AS h, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents)),
planted AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n ELSE n END AS a, CASE WHEN h % 10 = 0 AND n > 0 THEN 1 + (n - g % n) // (3 + g % 8) ELSE 1 END AS p FROM texts),
words AS (SELECT r, doc_id, n, unnest(range(n)) AS i, unnest(list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END)) AS word FROM planted),
matches AS (SELECT x.r, x.i, x.i - y.i AS q FROM words x JOIN words y ON x.r = y.r AND x.word = y.word AND y.i < x.i AND 4 * (x.i - y.i) <= x.n),
stretches AS (SELECT r, q, min(i) - q AS s, max(i) AS e, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM matches) GROUP BY r, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT * FROM stretches x WHERE NOT EXISTS (SELECT 1 FROM stretches y WHERE x.r = y.r AND y.q < x.q AND x.q % y.q = 0 AND y.s <= x.s AND y.e >= x.e)),
best AS (SELECT r, count(*) AS n_runs, string_agg(s || ',' || length || ',' || q || chr(10), '' ORDER BY s, q) AS lines, max(length) AS most, first(struct_pack(s := s, l := length, q := q) ORDER BY length DESC, s, q) AS b FROM runs GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(s + q, e + 1)) AS i FROM runs),
kept AS (SELECT w.r, string_agg(word, ' ' ORDER BY w.i) AS collapsed FROM words w LEFT JOIN gone g ON w.r = g.r AND w.i = g.i WHERE g.i IS NULL GROUP BY w.r)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, b.s::BIGINT AS start, b.l::BIGINT AS length, b.q::BIGINT AS period, (1000 * b.l // b.q)::BIGINT AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM texts LEFT JOIN best USING (r) LEFT JOIN kept USING (r)"""
