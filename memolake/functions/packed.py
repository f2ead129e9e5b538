"""Rows packed for a shuffle: those of one block as one compressed Arrow stream."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: About so many bytes of rows are held in a task before they are packed.
HELD = 32 << 20


def pack(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


def unpack(blobs: Iterable[bytes]) -> pa.Table:
    """All rows of packed tables of one schema, of which there is one at least."""
    return pa.concat_tables([pa.ipc.open_stream(b).read_all() for b in blobs]).combine_chunks()


def packed(rows: DataFrame, block: str, order: tuple[str, ...] = ()) -> DataFrame:
    """(block, rows: binary): rows without their column ``block`` (an integer), about HELD bytes of a task's rows at a time, those of
    a block as one value, sorted by ``order``."""
    kept = [c for c in rows.columns if c != block]

    def made(held: list) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        t = t.take(pa.array(np.lexsort([*(t[c].to_numpy() for c in reversed(order)), t[block].to_numpy()])))
        blocks, start = np.unique(t[block].to_numpy(), return_index=True)
        t = t.select(kept)
        for b, lo, hi in zip(blocks, start, [*start[1:], len(t)]):
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([pack(t.slice(lo, hi - lo))], pa.binary())], [block, "rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if len(batch):
                held.append(batch)
                size += batch.nbytes
            if size > HELD:
                yield from made(held)
                held, size = [], 0
        if held:
            yield from made(held)

    return rows.mapInArrow(run, f"{block} long, rows binary")
