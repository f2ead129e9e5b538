"""Training-order materialisation of token ids as binary shards (operator 10).

Tasks cut the stream of their documents' ids into sequences of a fixed length. With the counts per task each sequence
has an index in 0..N-1; a keyed Feistel permutation of the next larger even power of two, walked until it falls below
N again, gives it its slot in training order. Rows are dealt by ranges of slots, whole shards to a task, and each shard
is a file of fixed-stride records in slot order: record s lies in shard ``s // per_shard`` at byte
``s % per_shard * stride``, so a reader can start or go on at any slot without an index.

A task writes under a name of its own attempt and returns it with its rows; only names in the index (a table, written
once) are read, so repeated attempts do no harm.

Defined results: null text is empty and has only the end id; the last sequence of a task is filled up with the end id
(``n_tokens`` tells how many ids are real); repeated rows and null doc_ids are documents of their own; an empty table
gives no rows and no files; other columns don't matter.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memolake.llm.common import fresh_path, input_partitions, staged, table
from memolake.llm.hashing import blocks
from memolake.llm.tokens import tokenizer

LENGTH, PER_SHARD, KEY, ROUNDS = 2048, 2048, 0x5EED, 6
RANGE_BYTES = 1 << 28
SEQUENCES = "part int, number long, n_tokens int, doc_ids array<long>, ids binary"
INDEX = "slot long, shard long, byte_offset long, n_tokens int, ids_crc32 long, doc_ids array<long>, file string"


def squeezed(block: bytes) -> bytes:
    """Ids on their way to the shards: whole sequences shrink better than the shuffle's own compression does."""
    return zlib.compress(block, 6)


def feistel(index: np.ndarray, n: int, key: int = KEY, rounds: int = ROUNDS) -> np.ndarray:
    """A permutation of 0..n-1: values at or above n go through it again."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, h = np.uint64((1 << half) - 1), np.uint64(half)
    with np.errstate(over="ignore"):

        def once(x):
            left, right = x >> h, x & mask
            for r in range(rounds):
                f = (right + np.uint64(key * 0x9E3779B97F4A7C15 + r * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
                f = (f ^ (f >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
                left, right = right, left ^ ((f ^ (f >> np.uint64(32))) & mask)
            return left << h | right

        x = once(np.asarray(index, np.uint64))
        while len(out := np.flatnonzero(x >= n)):
            x[out] = once(x[out])
    return x.astype(np.int64)


def sequences(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, end_id: int, dtype: str = "<u2", pattern: str = "") -> DataFrame:
    """SEQUENCES of the documents' ids, squeezed; doc_ids: of the documents that a sequence has ids of, in order."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = TaskContext.get()
        part, number = context.partitionId() if context else 0, 0
        t = tokenizer(path, pattern)
        held, of, size = [], [], 0  # ids that wait, their documents
        most = np.iinfo(np.dtype(dtype)).max

        def rows(last: bool):
            nonlocal number, held, of, size
            ids, bounds = np.concatenate(held), np.cumsum([len(x) for x in held])
            out, at = [], 0
            while len(ids) - at >= length or (last and at < len(ids)):
                block = ids[at : at + length]
                first, final = np.searchsorted(bounds, at, "right"), np.searchsorted(bounds, at + len(block) - 1, "right")
                n = len(block)
                if block.max() > most:
                    raise ValueError(f"id {block.max()} doesn't fit {dtype}")
                if n < length:
                    block = np.concatenate((block, np.full(length - n, end_id, ids.dtype)))
                out.append((part, number, n, [x for x in of[first : final + 1] if x is not None], squeezed(block.astype(dtype).tobytes())))
                number, at = number + 1, at + length
            rest = np.searchsorted(bounds, at, "right")
            held, of, size = ([ids[at:]] if at < len(ids) else []), of[rest:], max(0, len(ids) - at)
            if held and len(of) > 1:  # the ids that are left go on with their own documents
                held = np.split(held[0], bounds[rest:-1] - at)
            return pd.DataFrame(out, columns=["part", "number", "n_tokens", "doc_ids", "ids"])

        for batch in batches:
            names, texts = batch["doc_id"].tolist(), batch["text"].tolist()
            for a, b in blocks(texts, 2_000_000):
                for doc, ids in zip(names[a:b], t.encode(texts[a:b])):
                    held.append(np.append(ids, np.uint32(end_id)))
                    of.append(None if pd.isna(doc) else int(doc))
                    size += len(held[-1])
                if size >= length:
                    yield rows(False)
        if size:
            yield rows(True)

    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return d.mapInPandas(cut, SEQUENCES)


def materialised(docs: DataFrame, path: str, folder: str, *, end_id: int, length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY, dtype: str = "<u2", pattern: str = "", **columns) -> DataFrame:
    """Writes the shards into folder and returns INDEX, one row per sequence."""
    spark = docs.sparkSession
    cut = staged(sequences(docs, path, length=length, end_id=end_id, dtype=dtype, pattern=pattern, **columns), "sequences")
    # One row for each task of the cut.
    counts = cut.groupBy("part").agg((F.max("number") + 1).alias("n")).orderBy("part").collect()
    starts, total = {}, 0
    for r in counts:
        starts[r["part"]], total = total, total + r["n"]
    stride = length * np.dtype(dtype).itemsize

    @F.pandas_udf("long")
    def slot(part: pd.Series, number: pd.Series) -> pd.Series:
        return pd.Series(feistel(part.map(starts).to_numpy(np.uint64) + number.to_numpy(np.uint64), total, key))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, root = fs.FileSystem.from_uri(folder)
        where.create_dir(root, recursive=True)
        out, name, shard, at = None, "", -1, 0
        for batch in batches:
            files, sums = [], []
            for s, ids in zip(batch["slot"].tolist(), batch["ids"]):
                ids = zlib.decompress(ids)
                if s // per_shard != shard:
                    if out:
                        out.close()
                    shard, at = s // per_shard, 0
                    name = f"shard-{shard:08d}-{uuid.uuid4().hex}.bin"
                    out = where.open_output_stream(f"{root}/{name}", compression=None)
                if at != s % per_shard * stride:
                    raise ValueError(f"slot {s} would lie at byte {at}")
                at += out.write(ids)
                files.append(name)
                sums.append(zlib.crc32(ids))
            slots = batch["slot"]
            yield pd.DataFrame({
                "slot": slots, "shard": slots // per_shard, "byte_offset": slots % per_shard * stride, "n_tokens": batch["n_tokens"],
                "ids_crc32": sums, "doc_ids": batch["doc_ids"], "file": files,
            })
        if out:
            out.close()

    dealt = cut.withColumn("slot", slot("part", "number")).withColumn("shard", F.floor(F.col("slot") / per_shard)).drop("part", "number")
    shards = max(1, -(-total // per_shard))
    # Ranges of shards: task i has the shards from i * shards / tasks on, of a bounded size in all.
    tasks = min(shards, max(1, input_partitions(spark), total * stride // RANGE_BYTES))
    dealt = dealt.repartitionById(tasks, F.floor(F.col("shard") * tasks / shards).cast("int")).drop("shard").sortWithinPartitions("slot")
    return staged(dealt.mapInPandas(write, INDEX), "shard-index")


def read_sequences(index: DataFrame, folder: str, start: int, count: int, *, length: int = LENGTH, per_shard: int = PER_SHARD, dtype: str = "<u2") -> Iterator[np.ndarray]:
    """Sequences from slot start on, in training order, read one after another from the shards."""
    where, root = fs.FileSystem.from_uri(folder)
    stride = length * np.dtype(dtype).itemsize
    wanted = index.where(F.col("shard").between(start // per_shard, (start + count - 1) // per_shard))
    for shard, name in sorted(wanted.select("shard", "file").distinct().collect()):
        first, last = max(start, shard * per_shard), min(start + count, (shard + 1) * per_shard)
        with where.open_input_file(f"{root}/{name}") as f:
            f.seek(first % per_shard * stride)
            for _ in range(first, last):
                got = f.read(stride)
                if len(got) < stride:
                    return
                yield np.frombuffer(got, dtype)


def op10_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    out = materialised(table(spark, sf_dir, "documents"), path, fresh_path(spark, "shards"), end_id=50256, pattern=public_tokenizers.PATTERN)
    return out.select("slot", "shard", "byte_offset", "n_tokens", "ids_crc32", "doc_ids")
