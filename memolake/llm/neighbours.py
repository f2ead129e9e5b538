"""Approximate nearest neighbours by inner product: multiprobe p-stable hashing (operator 1).

Vectors are brought to one length by one more coordinate (queries have 0 there), so that the nearest by distance are
those of the largest inner product. Each of several tables cuts a few Gaussian projections into intervals; a bucket is
a combination of intervals. Around a query, a neighbour at the expected distance falls into each bucket with a
probability that the projections give; buckets are visited in falling order of it until the tables together reach the
wanted chance of success. There are two passes. The first visits a few buckets, by a nearness that is measured for a
bounded sample of queries over all rows. The k-th best score that a query has then is a bound of its own: the second pass
visits what that bound asks for and the first one left out. So queries in dense places stop early, and others go on.

While there are at most 4,096 buckets all are put in order; beyond, a heap yields them one by one. A query that would visit
more than that many in a table is searched in full, as is one that found fewer than k rows, in blocks.

Work is dealt by (table, bucket group, block of rows, block of queries): a bucket group with many rows or queries is cut
into blocks of bounded size, so a task never holds an unbounded group, and emits at most k rows per query. Candidates of
all tables are merged and ranked by exact scores in double precision; of equal scores those of the smallest ids stay, so ties
don't pile up. Scores are made in tiles of bounded size.

Equal vectors are one entry that has the k + 1 smallest ids, which is all that any query's first k can need.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part, neither do those
whose length isn't the most frequent one (the longer on ties); rows with a null vec_id take no part; a repeated vec_id
with different vectors is each its own row, as a query (with a list of its own) and as a neighbour, and no row of an id is a
neighbour of that id; with k or fewer candidates all are returned;
an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from math import erf

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memolake.llm.common import staged, table

K = 20
TABLES, INTERVALS, WIDTH, SUCCESS, SEED = 4, 4, 1.0, 0.93, 17
#: Rows and queries that meet in a task at most (each block of rows gives every query that visits it k partial results, so
#: larger blocks give fewer), a sample's queries, and candidates that a task holds before it cuts them.
BLOCK, QUERY_BLOCK, SAMPLE, MOST_HELD = 65_536, 2048, 64, 1_000_000
#: The number of projections grows with the logarithm of the rows, up to this.
MOST_PROJECTIONS = 14
#: Buckets that are put in order at once, and that a query visits in a table at most; the first pass's chance; scores in a tile.
MOST_PROBES, FIRST_PASS, TILE = 4096, 0.5, 8_000_000

_erf = np.vectorize(erf, otypes=[float])


def normal_cdf(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + _erf(x / np.sqrt(2)))


class Tables:
    """Projections and interval borders of all tables; vectors are scaled to length 1."""

    def __init__(self, dim: int, projections: int, tables: int = TABLES, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.k, self.t = projections, tables
        self.a = rng.standard_normal((tables, dim, projections))
        # One random shift of the interval grid per projection; the outermost intervals are unbounded. Projections of
        # unit vectors have a spread of about 1 / sqrt(dim) of the Gaussian's length, scaled away here.
        self.a /= np.linalg.norm(self.a, axis=1, keepdims=True) / np.sqrt(dim)
        self.shift = rng.uniform(-0.5, 0.5, (tables, projections)) * WIDTH
        self.inner = (np.arange(1, INTERVALS) - INTERVALS / 2) * WIDTH

    def intervals(self, x: np.ndarray, t: int) -> np.ndarray:
        p = x @ self.a[t] + self.shift[t]
        return (p[:, :, None] >= self.inner).sum(2)

    def buckets(self, x: np.ndarray, t: int) -> np.ndarray:
        return self.intervals(x, t) @ (INTERVALS ** np.arange(self.k))

    def chances(self, q: np.ndarray, t: int, cosine: np.ndarray) -> np.ndarray:
        """For each query, projection and interval, the chance that a vector at the query's cosine falls there: it is projected to
        cosine * the query's projection, with a spread of the sine."""
        p = cosine[:, None] * (q @ self.a[t]) + self.shift[t]
        edges = np.concatenate(([-np.inf], self.inner, [np.inf]))
        sine = np.maximum(np.sqrt(np.maximum(0.0, 1 - cosine * cosine)), 1e-6)
        return np.diff(normal_cdf((edges - p[:, :, None]) / sine[:, None, None]), axis=2)

    def probes(self, q: np.ndarray, t: int, cosine: np.ndarray, wanted: float) -> list[np.ndarray | None]:
        """For each query the buckets in falling order of estimated success, up to the wanted chance in this table; None where
        they would be too many."""
        inside = self.chances(q, t, cosine)
        if INTERVALS**self.k > MOST_PROBES:
            return [visited(x, wanted) for x in inside]
        chance = inside[:, 0]
        for j in range(1, self.k):
            chance = (inside[:, j][:, :, None] * chance[:, None, :]).reshape(len(q), -1)
        order = np.argsort(-chance, axis=1, kind="stable")
        need = (np.cumsum(np.take_along_axis(chance, order, 1), axis=1) < wanted).sum(1) + 1
        return [o[:n] for o, n in zip(order, need)]


def visited(inside: np.ndarray, wanted: float) -> np.ndarray | None:
    """Buckets of one query (chances by projection and interval) in falling order of their product, from a heap: a bucket's
    followers take the next likely interval in one projection, from the last one that was changed on."""
    k = len(inside)
    order = np.argsort(-inside, axis=1)
    chance = np.take_along_axis(inside, order, 1)
    powers = INTERVALS ** np.arange(k, dtype=np.int64)
    heap = [(-float(chance[:, 0].prod()), 0, (0,) * k)]
    out, reached = [], 0.0
    while heap and reached < wanted:
        if len(out) == MOST_PROBES:
            return None
        p, last, at = heapq.heappop(heap)
        out.append(int((order[np.arange(k), at] * powers).sum()))
        reached -= p
        for j in range(last, k):
            if at[j] + 1 < INTERVALS and chance[j, at[j]] > 0:
                heapq.heappush(heap, (p * float(chance[j, at[j] + 1] / chance[j, at[j]]), j, (*at[:j], at[j] + 1, *at[j + 1 :])))
    return np.array(out, np.int64)


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    v = F.col(embedding).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    d = vectors.select(F.col(vec_id).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0))
    length = d.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1)
    return d.join(F.broadcast(length.select("n")), F.size("v") == F.col("n"), "left_semi")


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 0))


def best(score: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k highest scores of each row, of equal ones those with the least id; -inf doesn't count."""
    if score.shape[1] > k:
        cut = -np.partition(-score, k - 1, axis=1)[:, k - 1]
        rows, cols = np.nonzero((score >= cut[:, None]) & np.isfinite(score))
    else:
        rows, cols = np.nonzero(np.isfinite(score))
    by = np.lexsort((least[cols], -score[rows, cols], rows))
    rows, cols = rows[by], cols[by]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return rows[place < k], cols[place < k]


def nearest(vectors: DataFrame, is_query, *, vec_id: str = "vec_id", embedding: str = "embedding", k: int = K, success: float = SUCCESS) -> DataFrame:
    """(query_id, rank, vec_id, score) for each query row; is_query: from the id column to a condition."""
    spark = vectors.sparkSession
    rows = usable(vectors, vec_id, embedding)
    # Equal vectors: one entry, its id the smallest of them.
    rows = rows.withColumn("key", F.sha2(F.to_json("v"), 256))
    first = Window.partitionBy("key").orderBy("id")
    few = rows.select("key", "id").distinct().withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k + 1)
    ids = few.groupBy("key").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    entries = staged(rows.groupBy("key").agg(F.first("v").alias("v")).join(ids, "key").withColumn("entry", F.xxhash64("key")).withColumn("least", F.col("ids")[0]), "entries")
    # Equal queries are one search.
    asked = staged(rows.where(is_query(F.col("id"))).select("key", F.col("id").alias("query_id")).distinct(), "asked")
    queries = staged(entries.join(asked.select("key").distinct(), "key", "left_semi").select(F.col("entry").alias("query"), "v"), "queries")
    about = entries.agg(F.count(F.lit(1)).alias("n"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).alias("longest"), F.max(F.size("v")).alias("dim")).first()
    n, longest, dim = about["n"], about["longest"], about["dim"]
    schema = "query long, entry long, least long, score double"
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    projections = int(np.clip(round(np.log(max(n, 2) / 16) / np.log(INTERVALS)), 1, MOST_PROJECTIONS))
    tables = Tables(dim + 1, projections)

    def lifted(x: np.ndarray, query: bool) -> np.ndarray:
        x = x / longest
        norm = (x * x).sum(1)
        if query:
            return np.column_stack((x / np.sqrt(norm)[:, None], np.zeros(len(x))))
        return np.column_stack((x, np.sqrt(np.maximum(0, 1 - norm))))

    # The nearness of the k-th nearest, for a bounded sample of queries over all rows.
    sample = queries.orderBy("query").limit(SAMPLE).toPandas()
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    some = lifted(matrix(sample["v"]), True)

    def far(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.full((len(some), k + 1), -np.inf)
        for batch in batches:
            if len(batch):
                held = -np.partition(-np.concatenate((held, some @ lifted(matrix(batch["v"]), False).T), axis=1), k, axis=1)[:, : k + 1]
        yield pd.DataFrame({"i": np.repeat(np.arange(len(some)), k + 1), "s": held.ravel()})

    at = Window.partitionBy("i").orderBy(F.desc("s"))
    cosines = entries.select("v").mapInPandas(far, "i int, s double").where("s > -2").withColumn("r", F.row_number().over(at)).where(F.col("r") <= k + 1).groupBy("i").agg(F.min("s").alias("s"))
    cosine = float(np.quantile(np.clip(cosines.toPandas()["s"].to_numpy(), -1, 1), 0.25))
    groups = max(1, n // BLOCK)
    wanted = 1 - (1 - success) ** (1 / tables.t)
    few = 1 - (1 - FIRST_PASS) ** (1 / tables.t)

    def group_of(bucket: np.ndarray) -> np.ndarray:
        return ((bucket.astype(np.int64) * 0x9E3779B1) >> 7) % groups

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = lifted(matrix(batch["v"]), False) if len(batch) else None
            for t in range(tables.t if len(batch) else 0):
                b = tables.buckets(x, t)
                yield pd.DataFrame({"table": t, "group": group_of(b), "bucket": b, "entry": batch["entry"], "least": batch["least"], "v": batch["v"]})

    def probed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """What the queries (query, v, bound) visit: all of the first pass where bound is null, else what it left out. A query
        that visits too many has one row of no table."""
        for batch in batches:
            for a in range(0, len(batch), 256):
                part = batch.iloc[a : a + 256]
                v = matrix(part["v"])
                q, bound = lifted(v, True), part["bound"].to_numpy(float)
                # A score over both lengths is the cosine of the lifted vectors.
                own = np.clip(np.where(np.isnan(bound), cosine, bound / (np.linalg.norm(v, axis=1) * longest)), -1, 1)
                late, out = ~np.isnan(bound), []
                before = [tables.probes(q, t, np.full(len(q), cosine), few) for t in range(tables.t)]
                after = [tables.probes(q, t, own, wanted) for t in range(tables.t)] if late.any() else before
                for i, (query, vec) in enumerate(zip(part["query"], part["v"])):
                    mine = [(b[i] if not late[i] else c[i]) for b, c in zip(before, after)]
                    if any(x is None for x in mine):
                        out.append((-1, 0, query, vec, []))
                        continue
                    for t, buckets in enumerate(mine):
                        if late[i] and before[t][i] is not None:
                            buckets = buckets[~np.isin(buckets, before[t][i])]
                        g = group_of(buckets)
                        out += [(t, x, query, vec, buckets[g == x].astype(np.int64)) for x in np.unique(g)]
                yield pd.DataFrame(out, columns=["table", "group", "query", "v", "buckets"])

    keys = ["table", "group", "block", "query_block"]

    def scan(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query": [], "entry": [], "least": [], "score": []})
        if not len(left) or not len(right):
            return none
        x, q, entry, query, ids = matrix(left["v"]), matrix(right["v"]), left["entry"].to_numpy(), right["query"].to_numpy(), left["least"].to_numpy()
        lengths = right["buckets"].map(len).to_numpy()
        asks, asked_by = np.concatenate(right["buckets"].to_numpy()), np.repeat(np.arange(len(right)), lengths)
        order = np.argsort(asks, kind="stable")
        asks, asked_by = asks[order], asked_by[order]
        worst = np.full(len(right), -np.inf)  # what a score must reach to be among a query's first k + 1 so far
        out, held = [], 0

        def firsts() -> tuple:
            r, c, s = (np.concatenate(x) for x in zip(*out))
            by = np.lexsort((ids[c], -s, r))
            r, c, s = r[by], c[by], s[by]
            place = np.arange(len(r)) - np.searchsorted(r, r)
            last = place == k
            worst[r[last]] = s[last]
            return r[place <= k], c[place <= k], s[place <= k]

        for bucket, members in left.groupby("bucket", sort=False).indices.items():
            who = asked_by[np.searchsorted(asks, bucket, "left") : np.searchsorted(asks, bucket, "right")]
            tile = max(1, TILE // len(members))
            for a in range(0, len(who), tile):
                some = who[a : a + tile]
                score = q[some] @ x[members].T
                r, c = best(np.where(score >= worst[some][:, None], score, -np.inf), ids[members], k + 1)
                out.append((some[r], members[c], score[r, c]))
                held += len(r)
                if held > MOST_HELD:
                    out = [firsts()]
                    held = len(out[0][0])
        if not out:
            return none
        r, c, s = firsts()
        return pd.DataFrame({"query": query[r], "entry": entry[c], "least": ids[c], "score": s})

    data = entries.select("entry", "least", "v").mapInPandas(hashed, "table int, group long, bucket long, entry long, least long, v array<double>")
    blocks = data.groupBy("table", "group").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))

    def searched(asking: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """(candidates, queries that visit too many buckets) of one pass over queries (query, v, bound)."""
        probes = staged(asking.mapInPandas(probed, "table int, group long, query long, v array<double>, buckets array<long>"), f"probes-{name}")
        query_blocks = probes.select("table", "group").groupBy("table", "group").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("query_blocks"))
        sizes = staged(blocks.join(query_blocks, ["table", "group"]), "block-counts")
        rows = data.join(sizes, ["table", "group"]).withColumn("block", F.pmod(F.xxhash64("entry"), F.col("blocks"))).withColumn("query_block", F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)))
        again = sizes.select(*[F.col(c).alias(c) for c in sizes.columns])
        asks = probes.where("table >= 0").join(again, ["table", "group"]).withColumn("query_block", F.pmod(F.xxhash64("query"), F.col("query_blocks")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("blocks") - 1).cast("long"))))
        return rows.groupBy(*keys).cogroup(asks.groupBy(*keys)).applyInPandas(scan, schema), probes.where("table < 0").select("query").distinct()

    found, wide = searched(queries.withColumn("bound", F.lit(None).cast("double")), "first")
    first = staged(top_entries(found, k), "candidates")
    full = min(k + 1, n)
    bounds = first.groupBy("query").agg(F.count(F.lit(1)).alias("got"), F.min("score").alias("bound")).where(F.col("got") == full).select("query", "bound")
    found, wider = searched(queries.join(bounds, "query"), "second")
    merged = staged(top_entries(first.union(found), k), "candidates")
    # Queries that found fewer than they should, or would visit too many buckets: search them in full.
    lack = queries.select("query").join(merged.groupBy("query").agg(F.count(F.lit(1)).alias("got")), "query", "left").where(F.coalesce("got", F.lit(0)) < full).select("query")
    lack = lack.union(queries.select("query").join(bounds, "query", "left_anti")).union(wide).union(wider).distinct()
    short = staged(queries.join(lack, "query", "left_semi").select("query", "v"), "short")
    if lacking := short.count():
        cells = 1 + n // BLOCK
        broad = short.withColumn("query_block", F.pmod(F.xxhash64("query"), F.lit(1 + lacking // QUERY_BLOCK).cast("long")))
        broad = broad.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long"))))
        tall = entries.select("entry", "least", "v", F.pmod(F.xxhash64("entry"), F.lit(cells)).alias("block"))
        tall = tall.withColumn("query_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lacking // QUERY_BLOCK).cast("long"))))

        def scan_all(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            parts = [pd.DataFrame({"query": [], "entry": [], "least": [], "score": []})]
            if len(left) and len(right):
                x, q, ids, entry, query = matrix(left["v"]), matrix(right["v"]), left["least"].to_numpy(), left["entry"].to_numpy(), right["query"].to_numpy()
                tile = max(1, TILE // len(x))
                for a in range(0, len(q), tile):
                    score = q[a : a + tile] @ x.T
                    r, c = best(score, ids, k + 1)
                    parts.append(pd.DataFrame({"query": query[a + r], "entry": entry[c], "least": ids[c], "score": score[r, c]}))
            return pd.concat(parts[1:] or parts)

        all_of = tall.groupBy("block", "query_block").cogroup(broad.groupBy("block", "query_block")).applyInPandas(scan_all, schema)
        merged = merged.join(short, "query", "left_anti").union(top_entries(all_of, k))
    with_ids = merged.join(entries.select("entry", F.explode("ids").alias("vec_id")), "entry")
    named = with_ids.join(entries.select(F.col("entry").alias("query"), "key"), "query").select("key", "vec_id", "score")
    each = asked.join(named, "key").where("vec_id <> query_id")
    # A row is a query of its own: ids that stand for several vectors have as many lists.
    place = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")
    return each.select("query_id", F.row_number().over(place).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def top_entries(found: DataFrame, k: int) -> DataFrame:
    """The k + 1 highest distinct entries of each query, of equal ones those with the least id."""
    place = Window.partitionBy("query").orderBy(F.desc("score"), "least")
    once = found.groupBy("query", "entry", "least").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k + 1).drop("rank")


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)
