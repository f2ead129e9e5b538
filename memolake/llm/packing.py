"""Packing documents into sequences by Karmarkar-Karp multiway differencing (operator 4).

A task tokenizes its own documents. Full windows of a long document are sequences of their own; what remains of each
document is gathered into shards of a bounded number of pieces and shared out over m windows: every piece starts as a
partial partition of m loads, and the two partitions with the largest spread are merged again and again, largest loads
onto smallest. The result is m near-equal windows; m starts at the least possible number (with a hundredth of room from
100 windows on) and rises until no window exceeds the capacity. Nothing is shuffled, so no key can be hot; a task holds one shard.

Ids are counted per task (partition number and a running number), so sequences of different tasks never share an id.

Defined results: null text is empty and has only the end id; repeated rows and null doc_ids are packed as documents of
their own; an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memolake.llm.common import give_back, small_batches, table
from memolake.llm.hashing import blocks
from memolake.llm.tokens import KEEP_PIECES, tokenizer

CAPACITY, END_ID, SHARD = 4096, 2, 2048
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def differencing(sizes: np.ndarray, m: int) -> tuple[np.ndarray, int]:
    """Each size's window out of m, and the largest window's load."""
    n = len(sizes)
    loads, left, right, order = [], [-1] * n, [-1] * n, [None] * n
    heap = []
    for i, s in enumerate(sizes):
        x = np.zeros(m, np.int64)
        x[0] = s
        loads.append(x)
        heap.append((-int(s), i))
    heapq.heapify(heap)
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        x = loads[a] + loads[b][::-1]
        by = np.argsort(-x, kind="stable")
        x = x[by]
        loads[a] = loads[b] = None
        heapq.heappush(heap, (int(x[-1] - x[0]), len(loads)))
        loads.append(x)
        left.append(a)
        right.append(b)
        order.append(by)
    root = len(loads) - 1
    window, where = np.zeros(n, np.int64), {root: np.arange(m)}
    for node in range(root, -1, -1):
        w = where.pop(node)
        if left[node] < 0:
            window[node] = w[0]
        else:
            was = np.empty(m, np.int64)
            was[order[node]] = w
            where[left[node]], where[right[node]] = was, was[::-1]
    return window, int(loads[root][0])


def share_out(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Windows for sizes up to the capacity, as few as the differencing finds room in."""
    # Near-equal windows differ by about a hundredth: with less room than that the first try fails.
    m = max(1, int(np.ceil(sizes.sum() / capacity * (1.0 if sizes.sum() < 100 * capacity else 1.01))))
    while True:
        window, largest = differencing(sizes, m)
        if largest <= capacity:
            return window
        # At least what the largest window has over the capacity must go elsewhere.
        over = np.maximum(np.bincount(window, sizes, m) - capacity, 0).sum()
        m += max(1, int(over // capacity))


def packed(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, shard: int = SHARD, keep: int = KEEP_PIECES) -> DataFrame:
    """PIECES of all documents; path: of the vocabulary file; keep: how many pieces of text a task knows the ids of."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 33
        t = tokenizer(path)
        t.keep = keep
        held = []  # (doc_id, start, length, crc, doc_tokens): last pieces that wait for a window

        def piece(doc, ids, start):
            part = ids[start : start + capacity]
            return doc, start, len(part), zlib.crc32(part.astype("<u4").tobytes()), len(ids)

        def frame(rows):
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            return out

        def shared():
            nonlocal number, held
            window = share_out(np.array([x[2] for x in held], np.int64), capacity)
            used, ids = np.unique(window, return_inverse=True)
            at, rows = [0] * len(used), []
            for x, w in zip(held, ids):
                rows.append((*x, number + int(w), at[w]))
                at[w] += x[2]
            number, held = number + len(used), []
            return frame(rows)

        for batch in batches:
            docs_of, texts = batch["doc_id"].tolist(), batch["text"].tolist()
            full = []
            for a, b in blocks(texts):
                for doc, ids in zip(docs_of[a:b], t.encode(texts[a:b])):
                    ids = np.append(ids, np.uint32(end_id))
                    doc = None if pd.isna(doc) else int(doc)
                    whole = len(ids) // capacity * capacity
                    for start in range(0, whole, capacity):
                        full.append((*piece(doc, ids, start), number, 0))
                        number += 1
                    if whole < len(ids):
                        held.append(piece(doc, ids, whole))
                    if len(held) >= shard:
                        yield shared()
            if full:
                yield frame(full)
        if held:
            yield shared()
        t.clear()
        give_back()

    d = small_batches(docs, 4000).select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return d.mapInPandas(pack, PIECES)


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), vocabulary())
