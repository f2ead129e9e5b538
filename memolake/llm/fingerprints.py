"""Bottom-k sketches of word shingles (operator 5).

A sketch is the k smallest of a text's distinct shingle hashes. The k smallest of a union are among the k smallest of
its parts, so sketches of parts merge into that of the whole. Of the k smallest of the union of two sets, the share
that lies in both estimates resemblance; the share of one set's that lies in both estimates containment; and the
density of hashes below the k-th estimates how many there are.

The query pairs each document with the next by doc_id. Bounds cut the ids into ranges (their number is that of the
shuffle partitions); the first document of each range is sent to the range before it too, so each task can pair its
documents by itself, and texts are shuffled once.

Defined results: null text is empty; a text without words has an empty sketch, like only to another empty one; a text of
fewer than five words is one shingle; null doc_ids come last; rows that repeat a doc_id follow each other by text; with a
single row the next document is itself; an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memolake.llm import hashing
from memolake.llm.common import input_partitions, table

K, SHINGLE = 128, 5
#: Rows of a range at most, where there would be fewer ranges otherwise.
RANGE_ROWS = 50_000
LAST = (1 << 63) - 1


def bottom(h: np.ndarray, k: int = K) -> np.ndarray:
    """The k smallest distinct values, ascending."""
    if len(h) > 16 * k:
        u = np.unique(np.partition(h, 8 * k)[: 8 * k])
        if len(u) >= k:
            return u[:k]
    return np.unique(h)[:k]


def sketches(texts: list[str], k: int = K, n: int = SHINGLE) -> list[np.ndarray]:
    return [bottom(h, k) for a, b in hashing.blocks(texts) for h in hashing.shingles(texts[a:b], n)]


def compared(a: np.ndarray, b: np.ndarray, k: int = K) -> tuple[float, float]:
    """(resemblance, containment of a in b). Two empty sketches are alike."""
    if not len(a) or not len(b):
        alike = float(len(a) == len(b))
        return alike, alike if len(b) == 0 and len(a) == 0 else float(len(a) == 0)
    union = np.sort(np.concatenate((a, b)))
    twice = union[1:][union[1:] == union[:-1]]
    union = np.union1d(union, union)[:k]
    both = np.searchsorted(twice, union[-1], "right")
    own = np.searchsorted(a, union[-1], "right")
    return both / len(union), both / own if own else 0.0


def distinct(a: np.ndarray, k: int = K) -> float:
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[-1]) + 1) / 2.0**63)


def packed(a: np.ndarray) -> str:
    return base64.b64encode(a.astype(">u8").tobytes()).decode()


def unpacked(s: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(s), ">u8").astype(np.uint64)


def with_sketch(docs: DataFrame, *, text: str = "text", out: str = "sketch", k: int = K, n: int = SHINGLE) -> DataFrame:
    """docs and each text's sketch, an ascending array of longs."""

    @F.pandas_udf("array<long>")
    def sketch(texts: pd.Series) -> pd.Series:
        return pd.Series([x.astype(np.int64) for x in sketches(texts.fillna("").tolist(), k, n)])

    return docs.withColumn(out, sketch(F.col(text)))


def merged_sketches(df: DataFrame, by: list[str], *, sketch: str = "sketch", k: int = K) -> DataFrame:
    """Sketches of the unions of groups. A group's hashes are made distinct and cut to k per salt first, so that no
    task holds the sketches of a large group."""
    rows = df.select(*by, F.explode(sketch).alias("_h")).distinct().withColumn("_salt", F.pmod("_h", F.lit(64)))
    for keys in ([*by, "_salt"], by):
        from pyspark.sql import Window

        rows = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy("_h"))).where(F.col("_rank") <= k)
    return rows.groupBy(*by).agg(F.array_sort(F.collect_list("_h")).alias(sketch))


def compare_sketches(df: DataFrame, a: str, b: str, k: int = K) -> DataFrame:
    """df with resemblance, containment (of a in b), distinct_a and distinct_b."""

    @F.pandas_udf("resemblance double, containment double, distinct_a double, distinct_b double")
    def compare(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        rows = []
        for p, q in zip(x, y):
            p, q = np.asarray(p, np.uint64), np.asarray(q, np.uint64)
            rows.append((*compared(p, q, k), distinct(p, k), distinct(q, k)))
        return pd.DataFrame(rows, columns=["resemblance", "containment", "distinct_a", "distinct_b"])

    return df.withColumn("_c", compare(F.col(a), F.col(b))).select(*df.columns, "_c.*")


FINGERPRINTS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprinted(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = K, n: int = SHINGLE) -> DataFrame:
    """FINGERPRINTS for each document and its edited text: the second half replaced by the next document's beginning."""
    spark = docs.sparkSession
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("at"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ids = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("at"))
    # More ranges than partitions where they would hold too many rows.
    parts = max(input_partitions(spark), ids.count() // RANGE_ROWS)
    cuts = ids.agg(F.percentile_approx("at", [i / parts for i in range(1, parts)] or [0.5], 100_000)).first()[0]
    cuts = np.array(sorted(set(cuts or [])), np.int64)

    @F.pandas_udf("int")
    def range_of(at: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, at.to_numpy(np.int64), "left").astype(np.int32))

    # One row for each range: its number is bounded by that of the partitions.
    firsts = sorted((r["range"], r["first"]) for r in ids.groupBy(range_of("at").alias("range")).agg(F.min("at").alias("first")).collect())
    before = {first: firsts[i - 1][0] for i, (_, first) in enumerate(firsts)}

    @F.pandas_udf("array<int>")
    def ranges_of(at: pd.Series) -> pd.Series:
        own = np.searchsorted(cuts, at.to_numpy(np.int64), "left")
        return pd.Series([[int(r), before[x]] if x in before else [int(r)] for r, x in zip(own, at)])

    def fingerprints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the row that waits for the next one: (range, doc_id, text, sketch)
        for batch in batches:
            for a, b in hashing.blocks(batch["text"].tolist(), 2_000_000):
                part = batch.iloc[a:b]
                texts = part["text"].tolist()
                rows = [*zip(part["range"], part["doc_id"], texts, sketches(texts, k, n), part["visitor"])]
                pairs = []
                for row in rows:
                    if held is not None:
                        if row[0] == held[0]:
                            pairs.append((held, row))
                        held = None
                    if not row[4]:
                        held = row
                edits = [x[2][: len(x[2]) - len(x[2]) // 2] + y[2][: len(x[2]) // 2] for x, y in pairs]
                out = []
                for (x, y), edit, s in zip(pairs, edits, sketches(edits, k, n)):
                    sha = hashlib.sha256(edit.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((x[1], len(x[2]), sha, packed(x[3]), packed(s), compared(x[3], s, k)[0], compared(x[3], y[3], k)[0]))
                if out:
                    frame = pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
                    frame["doc_id"] = frame["doc_id"].astype("Int64")
                    yield frame

    d = d.select("doc_id", "at", "text", F.posexplode(ranges_of("at")).alias("visitor", "range"))
    d = d.repartitionById(parts, "range").sortWithinPartitions("range", "visitor", "at", "text")
    return d.mapInPandas(fingerprints, FINGERPRINTS)


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprinted(table(spark, sf_dir, "documents").select("doc_id", "text"))
