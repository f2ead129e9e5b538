"""Learning from the corpus: synonyms by co-occurrence."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from memolake.operators.lexical import FEW
from memolake.tables import little, numbered, staged


def corpus_synonyms(posted: DataFrame, term_df: DataFrame, n_docs: DataFrame, src_df: tuple[int, int] = (3, 60), least: int = 3, share: float = 0.6, lift: float = 8.0, dst_share: float = 0.08, only: DataFrame | None = None) -> DataFrame:
    """(src, dst, seen): words that stand by a topic word far more often than elsewhere. only: the topic words (term) that are asked
    for, else all.

    Each document's words that can be told of another are one string of bytes, numbers in order of frequency by their steps;
    documents with the same words are one row with a count. A topic word is in 60 documents at most, so their strings meet in
    one task, which counts the numbers and keeps those that are in enough of the documents: pairs are rows only once they
    hold, and how often a word is seen elsewhere is looked at for those alone.
    """
    t = term_df.crossJoin(F.broadcast(n_docs))  # one row
    is_src = F.col("df").between(*src_df)
    if only is not None:
        t = t.join(little(only.select("term").distinct().withColumn("_asked", F.lit(True)), FEW), "term", "left")
        is_src = is_src & F.col("_asked").isNotNull()
    is_dst = (F.col("df") >= least) & (F.col("df") <= F.greatest(F.lit(3), F.floor(F.col("n_docs") * dst_share))) & (F.col("df") <= F.col("n_docs") / lift)
    of = numbered(t.select("term", "df", "n_docs", is_src.alias("is_src"), is_dst.alias("is_dst")).where("is_src or is_dst"), F.desc("df"), "term")
    found = posted.select("doc_id", "term")
    if only is not None:  # few documents have one
        some = found.join(little(of.where("is_src").select("term"), FEW), "term", "left_semi").select("doc_id").distinct()
        found = found.join(little(staged(some, "of-topics"), FEW), "doc_id", "left_semi")
    number = F.col("number")
    held = found.join(little(of.select("term", "df", "is_src", number), FEW), "term").groupBy("doc_id")
    words = held.agg(F.collect_list(number).alias("numbers"), F.array_distinct(F.collect_list(F.when(F.col("is_src"), F.struct(number, "df")))).alias("topics")).where(F.size("topics") > 0)
    alike = words.select(steps("numbers").alias("numbers"), "topics").groupBy("numbers").agg(F.count(F.lit(1)).alias("weight"), F.first("topics").alias("topics"))
    near = alike.select(F.explode("topics").alias("t"), "weight", "numbers").select(F.col("t.number").alias("src"), F.col("t.df").alias("src_df"), "weight", "numbers")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list = []  # (topic word, its df, weights, numbers) of one that may go on in the next slice

        def counted() -> tuple:
            numbers, weights = np.concatenate([r[3] for r in rows]), np.concatenate([r[2] for r in rows])
            numbers, at = np.unique(numbers, return_inverse=True)
            seen = np.bincount(at, weights).astype(np.int64)
            enough = seen >= max(least, rows[0][1] * share)
            return rows[0][0], numbers[enough], seen[enough]

        def batch_of(done: list) -> pa.RecordBatch:
            src = np.repeat(np.array([d[0] for d in done], np.int64), [len(d[1]) for d in done])
            return pa.RecordBatch.from_arrays([pa.array(src), pa.array(np.concatenate([d[1] for d in done])), pa.array(np.concatenate([d[2] for d in done]))], ["src", "number", "seen"])

        for batch in batches:
            src, df, weight, packed = (batch.column(c) for c in ("src", "src_df", "weight", "numbers"))
            src, df, weight = src.to_numpy(), df.to_numpy(), weight.to_numpy()
            for lo, hi, sizes, numbers in walked(packed):
                done, ends = [], sizes.cumsum()
                cuts = [*np.flatnonzero(np.append(True, src[lo + 1 : hi] != src[lo : hi - 1])), hi - lo]
                weights = np.repeat(weight[lo:hi], sizes)
                for i, j in zip(cuts[:-1], cuts[1:]):
                    if rows and rows[0][0] != src[lo + i]:
                        done.append(counted())
                        rows = []
                    a, b = ends[i] - sizes[i], ends[j - 1]
                    rows.append((src[lo + i], df[lo + i], weights[a:b], numbers[a:b]))
                if done:
                    yield batch_of(done)
        if rows:
            yield batch_of([counted()])

    pairs = near.repartition("src").sortWithinPartitions("src").mapInArrow(count, "src long, number long, seen long").where("src <> number")
    src = of.where("is_src").select(number.alias("src_number"), F.col("term").alias("src"), F.col("df").alias("src_df"))
    dst = of.where("is_dst").select("number", F.col("term").alias("dst"), F.col("df").alias("dst_df"), "n_docs")
    pairs = pairs.withColumnRenamed("src", "src_number").join(little(src, FEW), "src_number").join(little(dst, FEW), "number")
    p = F.col("seen") / F.col("src_df")
    good = ~F.contains("dst", "src") & ~F.contains("src", "dst") & (p >= share) & (p / (F.col("dst_df") / F.col("n_docs")) >= lift)
    return pairs.where(good).select("src", "dst", "seen")


@F.pandas_udf(BinaryType())
def steps(numbers: pd.Series) -> pd.Series:
    """Distinct numbers in order by the steps between them, each in as many bytes of seven bits as it takes."""

    def put(row: np.ndarray) -> bytes:
        n = np.diff(np.unique(row), prepend=0)
        size = 1 + sum((n >= 1 << 7 * k).astype(np.int64) for k in range(1, 9))
        at = np.repeat(size.cumsum() - size, size)
        k = np.arange(len(at)) - at
        return ((np.repeat(n, size) >> 7 * k & 127) | np.where(k < np.repeat(size, size) - 1, 128, 0)).astype(np.uint8).tobytes()

    return numbers.map(put)


def walked(packed: pa.BinaryArray, most: int = 1 << 21) -> Iterator[tuple]:
    """(first row, row after the last, how many numbers each has, numbers) of slices of rows of ``steps``, about so many bytes at a
    time."""
    offsets = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1].astype(np.int64)
    data, lo = np.frombuffer(packed.buffers()[2], np.uint8), 0
    while lo < len(packed):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        b = data[offsets[lo] : offsets[hi]]
        last = np.flatnonzero(b < 128)
        first = np.append(0, last[:-1] + 1)
        n = np.add.reduceat((b & 127).astype(np.int64) << 7 * (np.arange(len(b)) - np.repeat(first, last - first + 1)), first)
        row_first = np.searchsorted(first, offsets[lo:hi] - offsets[lo])
        sizes, total = np.diff(np.append(row_first, len(n))), n.cumsum()
        yield lo, hi, sizes, total - np.repeat(total[row_first] - n[row_first], sizes)
        lo = hi


#: Words of one script in which words change their endings.
ENDS = "(?:하다|하는|한다|했다|된다|되는|으로|에서|에게|까지|부터|이다|인지|는지)$"


def anchors(queries: DataFrame, term_df: DataFrame, least: int = 2) -> DataFrame:
    """(qid, anchor): the word that tells most of a query (qid, word): identifiers before words of Hangul, those before inflected
    ones, the rarest first; words of fewer documents can't be one."""
    tier = F.when(F.col("word").rlike("^[가-힣]"), F.when(F.col("word").rlike(ENDS), 2).otherwise(1)).otherwise(0)
    d = queries.join(term_df, queries["word"] == term_df["term"]).where(F.col("df") >= least)
    return d.groupBy("qid").agg(F.min(F.struct(tier.alias("tier"), "df", "word")).alias("a")).select("qid", F.col("a.word").alias("anchor"))


def observed_synonyms(queries: DataFrame, additions: DataFrame, posted: DataFrame, term_df: DataFrame, n_docs: int, least: int = 3, share: float = 0.25) -> DataFrame:
    """(src, dst, seen): a query's anchor with each word that was added to it (qid, word): by a person's expansion, or of a document
    that meaning found. The word is none of the query's own, is known, not too common, and meets the anchor in documents
    enough; queries count."""
    own = queries.select("qid", "word").distinct()
    usable = term_df.where(F.col("df").between(2, max(3, int(n_docs * share))) & (F.length("term") >= 2)).select(F.col("term").alias("word"))
    a = anchors(own, term_df)
    pairs = additions.select("qid", "word").distinct().join(own, ["qid", "word"], "left_anti").join(usable, "word").join(a, "qid").select("qid", F.col("anchor").alias("src"), F.col("word").alias("dst"))
    pairs = staged(pairs, "added")
    each = pairs.select("src", "dst").distinct()
    # Postings of words that are in no pair are left out before any are unpacked or dealt.
    of = lambda c: posted.select("term", "doc_id").join(little(each.select(F.col(c).alias("term")).distinct(), FEW), "term", "left_semi").select(F.col("term").alias(c), "doc_id")
    of_src = staged(of("src"), "of-anchors")
    of_dst = of("dst").join(little(of_src.select("doc_id").distinct(), FEW), "doc_id", "left_semi")
    met = of_src.join(of_dst, "doc_id").join(little(each, FEW), ["src", "dst"]).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("together")).where(F.col("together") >= least)
    return pairs.join(met, ["src", "dst"]).groupBy("src", "dst").agg(F.countDistinct("qid").alias("seen"))


def merged_lexicon(parts: list[DataFrame]) -> DataFrame:
    """(src, dst, seen): lexicons as one, counts of a pair by the highest."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("src", "dst").agg(F.max("seen").alias("seen"))


def lexicon_drift(now: DataFrame, decided: int, limit: float = 0.4) -> DataFrame:
    """One row (pairs, sources, stale): a lexicon's size, and whether it has grown past the limit since a decision."""
    return now.agg(F.count(F.lit(1)).alias("pairs"), F.countDistinct("src").alias("sources")).withColumn("stale", F.col("pairs") > decided * (1 + limit))


def bridge_decision(runs: DataFrame) -> DataFrame:
    """One row (setting, hits, fires, on) of attached rows per setting (setting, size, qid, positive, hit), setting 0 without a bridge:
    the setting with the most gold hits, then the fewest fires, then the smallest; on if it has more hits than without, and
    no more false fires."""
    s = runs.groupBy("setting", "size").agg(F.countDistinct(F.when(F.col("positive") & F.col("hit"), F.col("qid"))).alias("hits"), F.countDistinct(F.when(~F.col("positive"), F.col("qid"))).alias("fires"))
    off = s.where("setting = 0").select(F.col("hits").alias("h0"), F.col("fires").alias("f0"))
    best = s.where("setting <> 0").crossJoin(F.broadcast(off)).where("hits > h0 and fires <= f0")  # one row
    one = best.agg(F.min(F.struct((-F.col("hits")).alias("h"), "fires", "size", "setting")).alias("b"))
    return one.select(F.coalesce("b.setting", F.lit(0)).alias("setting"), (-F.col("b.h")).alias("hits"), F.col("b.fires").alias("fires"), F.col("b").isNotNull().alias("on"))


def policy_choice(observations: DataFrame, arms: list[str], incumbent: str, alpha: float = 0.05) -> DataFrame:
    """One row (arm, observations, decision): which policy to serve, of observations (id, session, scores: map of arm to 0 or 1,
    costs: map of arm to seconds).

    The first observation of each session counts. By id, the earlier half chooses and the later one confirms: an arm wins a
    half if it gains, never loses, and 2^-gains is within the level shared by all alternatives; of those the one with the
    most hits is confirmed, if the 95th percentile of its cost stays within 1.1 times the incumbent's.
    """
    first = observations.groupBy("session").agg(F.min_by(F.struct("id", "scores", "costs"), "id").alias("o")).select("o.*")
    ids = first.select("id")
    n = first.count()
    cut = ids.orderBy("id").limit(n // 2).agg(F.max("id").alias("cut"))
    halves = first.crossJoin(F.broadcast(cut)).withColumn("train", F.coalesce(F.col("id") <= F.col("cut"), F.lit(False)))  # one row
    others = [a for a in arms if a != incumbent]
    each = halves.select("train", "scores", "costs", F.explode(F.array(*map(F.lit, others))).alias("arm"))
    mine, old = F.element_at("scores", F.col("arm")), F.element_at("scores", F.lit(incumbent))
    won = each.groupBy("arm", "train").agg(F.count(F.when(mine > old, 1)).alias("gains"), F.count(F.when(mine < old, 1)).alias("losses"), F.sum(mine).alias("hits"))
    good = (F.col("losses") == 0) & (F.col("gains") > 0) & (F.pow(F.lit(2.0), -F.col("gains")) <= alpha / max(len(others), 1))
    won = won.withColumn("won", good)
    best = won.where("train and won").agg(F.min(F.struct((-F.col("hits")).alias("h"), "arm")).alias("b")).select(F.col("b.arm").alias("arm"))
    sure = best.join(won.where("not train and won").select("arm"), "arm")
    at = max(0, -(-95 * (n - n // 2) // 100) - 1)
    cost = lambda a: halves.where("not train").select(F.element_at("costs", a).alias("c"))
    chosen = sure.first()  # one row at most
    arm, decision = incumbent, "retained" if n >= 2 else "insufficient"
    if chosen and n >= 2:
        place = lambda d: d.orderBy("c").limit(at + 1).agg(F.max("c")).first()[0]
        if place(cost(F.lit(chosen["arm"]))) <= 1.1 * place(cost(F.lit(incumbent))):
            arm, decision = chosen["arm"], "changed"
    return observations.sparkSession.createDataFrame([(arm, n, decision)], "arm string, observations long, decision string")


def observation_counts(observations: DataFrame, signature: str) -> DataFrame:
    """(status, n) of policy observations (identity, measured, edited, exposed): other (of another signature), excluded, measured or
    pending."""
    status = F.when(~F.col("identity").startswith(signature), "other").when((F.col("measured") < 0) | F.col("edited") | F.col("exposed"), "excluded").when(F.col("measured") == 1, "measured").otherwise("pending")
    return observations.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def certified(support: DataFrame, observations: DataFrame, docs: DataFrame, current: DataFrame) -> DataFrame:
    """(policy, certified) of support (policy, id): each supporting observation (id, path, sha, measured, settled, edited, exposed)
    still names a current document (docs: path, sha, doc_id) with that content, and is measured, settled, unedited and
    unexposed."""
    good = observations.where("measured = 1 and settled and not edited and not exposed").join(docs.select("path", "sha", "doc_id"), ["path", "sha"]).join(current.select("doc_id"), "doc_id", "left_semi").select("id").distinct()
    d = support.join(good.withColumn("good", F.lit(True)), "id", "left")
    return d.groupBy("policy").agg((F.count(F.lit(1)) == F.count("good")).alias("certified"))


def bridge(queries: DataFrame, lexicon: DataFrame, least: int = 2, per_word: int = 3, most: int = 8) -> DataFrame:
    """(qid, dst): what the lexicon adds to each query's words: the most seen per word, few in all."""
    hit = queries.join(lexicon.where(F.col("seen") >= least), queries["word"] == lexicon["src"])
    place = Window.partitionBy("qid", "word").orderBy(F.desc("seen"), F.desc("dst"))
    some = hit.withColumn("r", F.row_number().over(place)).where(F.col("r") <= per_word).select("qid", "dst").distinct()
    return some.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy("dst"))).where(F.col("r") <= most).select("qid", "dst")
