"""N-gram Jaccard join and its components (operator 3).

1. A pass over the texts counts shingles into a table of fixed size; (count, hash) is a total order of shingles, rare
   ones first. A second pass gives each document its set's size, a 64-bit identity, a parity bitmap (each shingle flips
   one of about as many bits as the set has shingles) and its prefix: of n shingles the first n - ceil(t n) + l, of which
   linked sets share l, here l = 1 + (n - ceil(t n)) / 2. A set's bitmap and prefix are kept once in each task.
2. Equal sets are one set; sets of equal size and prefix are one group. One shuffle brings (shingle, group, size and
   place) together; only shingles that two groups share stay. Shingles whose count is high have their lists cut in salted
   parts. A group that shares fewer of its shingles than it would with the smallest set that it may be linked to goes, with
   most of those that meet by chance; then the first n - ceil(t n) + 1 shingles, of which linked sets share one, are enough.
   Bitmaps and sets never travel with lists.
3. In each round, each group is compared with one other: of the groups that stand first on its lists, in its band of
   sizes, the one met most often; first is the one with the fewest rare shingles of its own, later weighed at random. Verified links make components. A list within one
   component is closed, so a large group of near copies doesn't multiply. Rounds go on while lists would still give many
   pairs for their rows, and a round takes a tenth of these pairs away.
4. Then all pairs of groups on an open list that are not yet one component are joined, under bounds on sizes, on the
   places of the shared shingle and, once expanded to sets, on the bitmaps (unequal bits never exceed the sets' symmetric
   difference).
5. Every pair is verified on the exact shingle sets of its two texts, which are made again only for sets in pairs that
   pass the bitmaps.

No link between different components is lost, as each such pair passes 4; pairs inside a component are not needed.

Defined results: null text, and text without words, has no shingles and no link; repeated rows are linked by their
equal sets; a null doc_id is never the smallest, and is the component of rows linked only with null ids; an empty table
gives no rows; other columns don't matter. Two sets of one 64-bit identity (about pairs / 2**64) would be taken as equal.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memolake.llm import hashing
from memolake.llm.common import give_back, released, small_batches, staged, table

#: Cells of the count table; bits of a bitmap at most.
BITS, MOST_MAP_BITS, SALTS = 22, 1 << 15, 16
#: A shingle counted so often has its list cut into parts.
HOT, PARTS = 20_000, 64
#: Rounds go on while open lists would give more than so many pairs for each row of all lists.
PAIRS_PER_ROW = 4
#: So many ids or pairs, some 50 bytes each at most, are broadcast; more are joined by a shuffle.
FEW = 500_000
WORDS, PERCENT = 5, 80


def sets_of(texts: list[str], n: int) -> list[np.ndarray]:
    return [np.unique(h) for a, b in hashing.blocks(texts) for h in hashing.shingles(texts[a:b], n)]


def parted(batches: Iterator[pd.DataFrame], chars: int = 4_000_000) -> Iterator[pd.DataFrame]:
    """Batches cut to so many characters, so that a task holds the sets of few texts at a time."""
    for batch in batches:
        for a, b in hashing.blocks(batch["text"].tolist(), chars):
            yield batch.iloc[a:b]
    give_back()


def identity(s: np.ndarray) -> int:
    """63 bits of the sum of mixed hashes and the size."""
    x = hashing.mix(hashing.mix(s + np.uint64(0x1234567)).sum(keepdims=True) + np.uint64(len(s)))
    return int(x[0] >> np.uint64(1))


def bitmap(s: np.ndarray) -> np.ndarray:
    """Parities of a power of two of cells, at least as many as shingles up to the bound; half of one is its halves' XOR."""
    bits = min(max(64, 1 << (len(s) - 1).bit_length()), MOST_MAP_BITS)
    flips = np.bincount((hashing.mix(s) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8)).view("<i8")


def shingle_counts(docs: DataFrame, words: int, bits: int = BITS) -> np.ndarray:
    """How many shingles fall to each of 2**bits cells: a table of fixed size, summed over all texts by blocks of cells,
    first over salts, then over all tasks."""
    size = min(1 << 17, 1 << bits)

    def count_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 << bits, np.int32)
        for part in parted(batches):
            for s in sets_of(part["text"].tolist(), words):
                np.add.at(total, (s & np.uint64((1 << bits) - 1)).astype(np.int64), 1)
        salt = TaskContext.get().partitionId() % SALTS
        yield from packed({i: total[i : i + size] for i in range(0, 1 << bits, size) if total[i : i + size].any()}, salt)

    def packed(sums: dict, salt: int) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"block": [*sums], "salt": salt, "cells": [zlib.compress(np.minimum(x, 2**31 - 1).astype("<i4").tobytes(), 1) for x in sums.values()]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for batch in batches:
            for block, cells in zip(batch["block"], batch["cells"]):
                sums[block] = sums.get(block, 0) + np.frombuffer(zlib.decompress(cells), "<i4").astype(np.int64)
        yield from packed(sums, 0)

    schema = "block int, salt int, cells binary"
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInPandas(count_cells, schema)
    rows = rows.repartition("block", "salt").mapInPandas(add, schema).repartition("block").mapInPandas(add, schema)
    total = np.zeros(1 << bits, np.int32)
    for row in rows.collect():  # 2**bits numbers in all, squeezed
        total[row["block"] : row["block"] + size] = np.frombuffer(zlib.decompress(row["cells"]), "<i4")
    return total


def described(docs: DataFrame, counts: np.ndarray, words: int, percent: int) -> DataFrame:
    """(doc_id, key, n, sid, cold, prefix, map): key is a hash of the text; sid is null without shingles; prefix, of which the first ``cold`` are not hot,
    and map are null where the task had the set before."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)  # 2**BITS numbers

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, had = shared.value, set()
        mask = np.uint64(len(counts) - 1)
        for part in parted(batches):
            n, sid, cold, prefix, maps = [], [], [], [], []
            for s in sets_of(part["text"].tolist(), words):
                n.append(len(s))
                sid.append(identity(s) if len(s) else None)
                if not len(s) or sid[-1] in had:
                    cold.append(0)
                    prefix.append(None)
                    maps.append(None)
                    continue
                had.add(sid[-1])
                c = counts[(s & mask).astype(np.int64)]
                spare = len(s) - -(-percent * len(s) // 100)
                order = np.lexsort((s, c))[: spare + 1 + spare // 2]
                cold.append(int((c[order] < HOT).sum()))
                prefix.append(s[order].astype(np.int64))
                maps.append(bitmap(s))
            yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "key": part["key"], "n": n, "sid": pd.array(sid, "Int64"), "cold": cold, "prefix": prefix, "map": maps})

    d = docs.select("doc_id", F.xxhash64("text").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    return d.mapInPandas(describe, "doc_id long, key long, n long, sid long, cold int, prefix array<long>, map array<long>")


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """(sid, shingles) of the rows of docs (sid, text) whose text has that set."""

    def shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parted(batches):
            got = [(i, s) for i, s in zip(part["sid"], sets_of(part["text"].tolist(), words)) if len(s) and identity(s) == i]
            yield pd.DataFrame({"sid": [i for i, _ in got], "shingles": [s.astype(np.int64) for _, s in got]})

    return docs.select("sid", "text").where(F.col("text").isNotNull()).mapInPandas(shingles, "sid long, shingles array<long>")


def unequal_bits(a: str, b: str) -> Column:
    """In how many bits two bitmaps differ, both brought to the smaller one's size."""
    least = F.least(F.size(a), F.size(b))

    def word(of: str, i: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(0), (F.size(of) / least).cast("int") - 1), F.lit(0).cast("long"), lambda x, j: x.bitwiseXOR(F.col(of)[i + j * least]))

    return F.aggregate(F.sequence(F.lit(0), least - 1), F.lit(0), lambda x, i: x + F.bit_count(word(a, i).bitwiseXOR(word(b, i))))


def may_link(n_a: Column, n_b: Column, percent: int) -> Column:
    """False only where sizes rule a link out."""
    return F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * percent


def components(links: DataFrame) -> DataFrame:
    """(node, root) for the nodes of links (a, b); root: the smallest node reachable.

    Each round every node and its old root take the smallest root among the node's neighbours', then their root's root.
    Roots are hooked too, so whole trees join: on chains with shuffled ids, 1,000 nodes take about 14 rounds and 100,000
    about 22. Rounds are tables in the shared folder, the one before removed, and go on until nothing changes; roots only
    fall, so that comes.
    """
    both = staged(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    roots = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root"))
    roots = new = staged(roots, "roots")
    while True:
        near = both.join(roots, both["b"] == roots["node"]).groupBy("a").agg(F.min("root").alias("near"))
        own = F.struct("node", F.least("root", "near").alias("root"), F.col("root").alias("was"))
        hook = F.struct(F.col("root").alias("node"), F.col("near").alias("root"), F.lit(None).cast(roots.schema["root"].dataType).alias("was"))
        lower = roots.join(near, roots["node"] == near["a"]).select(F.explode(F.array(own, hook)).alias("t")).groupBy("t.node").agg(F.min("t.root").alias("root"), F.max("t.was").alias("was"))
        up = roots.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
        old, new = new, lower.join(up, F.col("root") == F.col("_node"), "left").select("node", F.least("root", F.coalesce("_root", "root")).alias("root"), "was")
        new = staged(new, "roots")
        released(old)
        roots = new.select("node", "root")
        if not new.where("root <> was").limit(1).count():
            released(both)
            return roots


def verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of set identities that are linked, as a table."""
    side = lambda x: sets.select(F.col("sid").alias(x), F.col("n").alias(f"n_{x}"), F.col("map").alias(f"map_{x}"), F.col("rep").alias(f"rep_{x}"))
    both = F.col("n_a") + F.col("n_b")
    close = pairs.distinct().join(side("a"), "a").join(side("b"), "b")
    close = close.where(may_link(F.col("n_a"), F.col("n_b"), percent)).where(unequal_bits("map_a", "map_b") * (100 + percent) <= both * (100 - percent))
    close = staged(close.select("a", "b", "n_a", "n_b", "rep_a", "rep_b"), "pairs")
    little = F.broadcast if close.count() <= FEW else lambda x: x
    texts = docs.select(F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), "text")

    def sets_on(x: str) -> DataFrame:
        """(sid, shingles) of one side."""
        wanted = close.select(F.col(f"rep_{x}").alias("doc_id"), F.col(x).alias("sid")).distinct()
        return shingle_sets(texts.join(little(wanted), "doc_id"), words)

    right = sets_on("b").join(little(close.select("a", "b", "n_a", "n_b")), F.col("sid") == F.col("b")).select("a", "b", "n_a", "n_b", F.col("shingles").alias("s_b"))
    left = sets_on("a").select(F.col("sid").alias("a"), F.col("shingles").alias("s_a"))
    common = F.size(F.array_intersect("s_a", "s_b"))
    found = staged(right.join(left.hint("merge"), "a").where(common * (100 + percent) >= both * percent).select("a", "b").distinct(), "links")
    released(close)
    return found


def spare(n: Column, percent: int) -> Column:
    """How many of a set's n shingles may be missing in a linked one."""
    return F.floor(n * (100 - percent) / 100)


def shared_lists(rows: DataFrame) -> DataFrame:
    """(token, part, gid, n, place): the prefix shingles that more than one group has. One shuffle, by shingle and part."""
    tokens = rows.where("prefix is not null").select(F.xxhash64("n", "prefix").alias("gid"), "n", "cold", F.posexplode("prefix").alias("place", "token"))
    part = F.when(F.col("place") < F.col("cold"), F.lit(-1)).otherwise(F.pmod("gid", F.lit(PARTS)).cast("int"))
    # Size and place in one number; a set that several tasks had gives equal rows.
    tokens = tokens.select("token", part.alias("part"), "gid", (F.col("n") * F.lit(1 << 31) + F.col("place")).alias("at"))
    tokens = tokens.repartition("token", "part").groupBy("token", "part", "gid").agg(F.min("at").alias("at"))
    tokens = tokens.withColumn("held", F.count(F.lit(1)).over(Window.partitionBy("token", "part"))).where("held > 1 or part >= 0")
    return tokens.select("token", "part", "gid", F.shiftright("at", 31).alias("n"), (F.col("at") % F.lit(1 << 31)).alias("place"))


def promising(lists: DataFrame, percent: int) -> DataFrame:
    """lists of the groups that share enough of their shingles for a link, and of those the first that a link needs one of."""
    least = 1 + F.floor(spare(F.ceil(F.col("n") * percent / 100), percent) / 2)
    enough = lists.groupBy("gid").agg(F.count(F.lit(1)).alias("shared"), F.first("n").alias("n")).where(F.col("shared") >= least).select("gid")
    return lists.where(F.col("place") <= spare(F.col("n"), percent)).join(enough, "gid", "left_semi")


def of_groups(known: DataFrame) -> DataFrame:
    """(gid, low, high): the set of a group with the lowest root, and that with the highest, as (root, sid)."""
    mine = F.struct("root", "sid")
    return known.groupBy("gid").agg(F.min(mine).alias("low"), F.max(mine).alias("high"))


def first_ones(lists: DataFrame, turn: int, percent: int) -> DataFrame:
    """(gid, other): for each group the one that stands first most often on its lists, among those of like size and
    another root. First is where the shingle has the lowest place: that group has the fewest rare shingles of its own, so
    of a text's edited copies the one that is nearest to all. After the first turn places are weighed at random. Bands of
    sizes are moved by half a band every other turn."""
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(100 / percent)) if percent < 100 else 1.0) + F.lit(turn % 2 / 2))
    toss = F.pmod(F.xxhash64("gid", F.lit(turn)), F.lit(1 << 20))
    first = F.min(F.struct(((F.col("place") + 1) * (1 << 20 if turn == 0 else toss)).alias("h"), toss.alias("toss"), "gid", "root"))
    met = lists.withColumn("band", band).withColumn("first", first.over(Window.partitionBy("token", "part", "band")))
    met = met.where("first.root <> root").select("gid", F.col("first.gid").alias("other"))
    often = met.repartition("gid").groupBy("gid", "other").agg(F.count(F.lit(1)).alias("times"))
    return often.groupBy("gid").agg(F.max(F.struct("times", "other")).alias("best")).select("gid", F.col("best.other").alias("other"))


def clustered(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, key, n_shingles, root, component_id), one row for each row of docs; key: a hash of the text, root: a number of
    the component, null without shingles."""
    docs = small_batches(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    all_rows = staged(described(docs, shingle_counts(docs, words), words, percent), "described")
    shared = staged(shared_lists(all_rows), "lists")
    lists = staged(promising(shared, percent), "lists")
    released(shared)
    sets = all_rows.where("n > 0").groupBy("sid").agg(
        F.min("doc_id").alias("least"), F.coalesce(F.min("doc_id"), F.lit(-1)).alias("rep"), F.first("n").alias("n"), F.first("map", ignorenulls=True).alias("map"),
        F.first(F.when(F.col("prefix").isNotNull(), F.xxhash64("n", "prefix")), ignorenulls=True).alias("gid"),
    )
    sets = staged(sets, "distinct-sets")
    rows = staged(all_rows.select("doc_id", "key", "n", "sid"), "set-of-row")
    released(all_rows)  # with the prefixes

    known = sets.select("sid", "gid", "n", F.col("sid").alias("root"))
    open_lists, list_rows, before = lists, lists.count(), float("inf")
    for turn in count():
        groups = of_groups(known)
        on = lists.withColumn("low", F.col("gid"))
        if turn:
            on = open_lists.select("token", "part", "gid", "n", "place").join(groups.select("gid", F.col("low.root").alias("low"), F.col("high.root").alias("high")), "gid")
            # Lists of which all groups are one component are done with.
            of_part = Window.partitionBy("token", "part")
            on = on.withColumn("least", F.min("low").over(of_part)).withColumn("most", F.max("high").over(of_part))
            on = on.withColumn("fellows", F.count(F.lit(1)).over(of_part) - F.count(F.lit(1)).over(Window.partitionBy("token", "part", "low")))
            hot = on.where("part >= 0")
            still = hot.groupBy("token").agg(F.min("least").alias("least"), F.max("most").alias("most")).where("least < most").select("token")
            on = on.where("part < 0 and least < most").unionByName(hot.join(still, "token", "left_semi"))
            old, open_lists = open_lists, staged(on.select("token", "part", "gid", "n", "place", "low", "high", "fellows"), "lists")
            released(old)
            ahead = open_lists.agg(F.coalesce(F.sum("fellows"), F.lit(0))).first()[0] / 2
            if ahead <= PAIRS_PER_ROW * list_rows or ahead > 0.9 * before:
                break
            before, on = ahead, open_lists
        pick = F.col("low.sid") if turn % 2 == 0 else F.col("high.sid")
        named = groups.select("gid", pick.alias("sid"))
        stars = first_ones(on.select("token", "part", "gid", "n", "place", F.col("low").alias("root")), turn, percent)
        stars = stars.join(named.select("gid", F.col("sid").alias("b")), "gid").join(named.select(F.col("gid").alias("other"), F.col("sid").alias("a")), "other").select("a", "b")
        inside = known.join(groups.where("low.root < high.root").select("gid", F.col("low.sid").alias("a"), F.col("low.root").alias("_root")), "gid").where("root <> _root").select("a", F.col("sid").alias("b"))
        links = verified(stars.union(inside), sets, docs, words, percent)
        old, known = known, joined(known, links)
        released(old, links)

    # What is left: pairs on a list, or in a group, that aren't yet one component.
    x, y = open_lists.alias("x"), open_lists.alias("y")
    apart = ~((F.col("x.low") == F.col("y.high")) & (F.col("x.high") == F.col("y.low")) & (F.col("x.low") == F.col("x.high")))
    room = F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place")) * (100 + percent) >= (F.col("x.n") + F.col("y.n")) * percent
    larger = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.gid") < F.col("y.gid")))
    across = x.join(y, (F.col("x.token") == F.col("y.token")) & larger & may_link(F.col("x.n"), F.col("y.n"), percent) & room & apart)
    across = across.select(F.col("x.gid").alias("g"), F.col("y.gid").alias("h")).union(of_groups(known).where("low.root < high.root").select(F.col("gid").alias("g"), F.col("gid").alias("h"))).distinct()
    one = lambda g, c: known.select(F.col("gid").alias(g), F.col("sid").alias(c), F.col("root").alias(f"root_{c}"))
    rest = across.join(one("g", "a"), "g").join(one("h", "b"), "h").where("root_a <> root_b and (g <> h or a < b)").select("a", "b")
    links = verified(rest, sets, docs, words, percent)
    released(open_lists)
    known = joined(known, links)
    released(links)

    members = sets.select("sid", "least").join(known.select("sid", "root"), "sid")
    lowest = members.groupBy("root").agg(F.min("least").alias("component_id"))
    of_set = members.join(lowest, "root").select("sid", "root", "component_id")
    out = rows.join(of_set, "sid", "left")
    return out.select("doc_id", "key", "root", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def joined(known: DataFrame, links: DataFrame) -> DataFrame:
    """known (sid, gid, n, root) with the roots that further links (a, b) of sids lead to, as a table."""
    of = lambda x: known.select(F.col("sid").alias(x), F.col("root").alias(f"root_{x}"))
    edges = links.join(of("a"), "a").join(of("b"), "b").where("root_a <> root_b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
    roots = components(edges)
    return staged(known.join(roots.select("node", F.col("root").alias("_root")), known["root"] == F.col("node"), "left").select("sid", "gid", "n", F.coalesce("_root", "root").alias("root")), "known")


def linked(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row for each row of docs."""
    return clustered(docs, **options).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with one row of each component, that of the smallest doc_id (nulls last; of several, the least hash of the
    text), and the rows without shingles; rows that repeat a kept one's id and text go."""
    rows = clustered(docs, doc_id=doc_id, text=text, **options).groupBy("root", "doc_id", "key").agg(F.count(F.lit(1)).alias("copies"))
    first = rows.where("root is not null").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key", "copies")).alias("one"))
    chosen = first.select("one.doc_id", "one.key", "one.copies").union(rows.where("root is null").select("doc_id", "key", "copies"))
    chosen = staged(chosen.select(F.col("doc_id").alias("_kept_id"), F.col("key").alias("_kept_key"), "copies"), "chosen")
    little = F.broadcast if chosen.count() <= FEW else lambda x: x
    mine = F.col(doc_id).cast("long").eqNullSafe(F.col("_kept_id")) & (F.xxhash64(text) == F.col("_kept_key"))
    alone = docs.join(little(chosen.where("copies = 1")), mine, "left_semi")
    again = docs.join(little(chosen.where("copies > 1")), mine, "left_semi").dropDuplicates([doc_id, text])
    return alone.union(again)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "documents"), words=3, percent=90)
