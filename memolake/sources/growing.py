"""A streaming source of text files that grow: transcripts that are written line by line.

An offset has the byte up to which each file was read, always the end of a line, so the last line waits until it is whole. A
file that is shorter than what was read of it was written anew and is read from its start; one that is gone is forgotten, and
read from its start if it comes back. Reads are split by bytes: a partition has the lines that begin in its range.

The offset has an entry for each file, so the folder should hold the files that still grow; closed ones belong elsewhere.
Files are reached by Arrow's file systems (local paths, or URIs that those know).
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

BLOCK = 1 << 20
#: Bytes of a partition, about.
SPLIT = 64 << 20
SCHEMA = "path string, at long, line string"


class Lines(InputPartition):
    """Lines of a file that begin from one byte to before another; the file counts up to ``end``."""

    def __init__(self, path: str, begin: int, until: int, end: int):
        self.path, self.begin, self.until, self.end = path, begin, until, end


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def sizes(folder: str, pattern: str) -> dict[str, int]:
    fs, inner = opened(folder)
    found = fs.get_file_info(pafs.FileSelector(inner, recursive=True, allow_not_found=True))
    return {f.path: f.size for f in found if f.type == pafs.FileType.File and fnmatch.fnmatch(f.base_name, pattern) and not f.base_name.startswith((".", "_"))}


def last_end(fs: pafs.FileSystem, path: str, size: int, known: int = 0) -> int:
    """Where the last whole line of the first ``size`` bytes ends; a line ends at ``known``, if the file is that long."""
    least = known if known <= size else 0
    with fs.open_input_file(path) as f:
        end = size
        while end > least:
            begin = max(least, end - BLOCK)
            f.seek(begin)
            at = f.read(end - begin).rfind(b"\n")
            if at >= 0:
                return begin + at + 1
            end = begin
    return least


def lines_in(fs: pafs.FileSystem, part: Lines) -> Iterator[tuple[int, bytes]]:
    """(first byte, line) of a partition's lines, a block at a time."""
    if part.begin >= part.end:
        return
    with fs.open_input_file(part.path) as f:
        skip = part.begin > 0
        at = part.begin - 1 if skip else 0
        f.seek(at)
        held, place = b"", at
        while at < part.end and place < part.until:
            block = f.read(min(BLOCK, part.end - at))
            if not block:
                break
            at += len(block)
            held += block
            *whole, rest = held.split(b"\n")
            for line in whole:
                if skip:
                    skip = False
                elif place < part.until:
                    yield place, line
                else:
                    return
                place += len(line) + 1
            held = rest


class Reading:
    def __init__(self, folder: str, pattern: str, split: int):
        self.folder, self.pattern, self.split = folder, pattern, split

    def parts(self, ranges: list[tuple[str, int, int]]) -> list[Lines]:
        return [Lines(p, b, min(b + self.split, e), e) for p, begin, e in ranges for b in range(begin, e, self.split)]

    def read(self, partition: Lines) -> Iterator[pa.RecordBatch]:
        fs, _ = opened(self.folder)
        rows, held = [], 0

        def batch():
            columns = [pa.array([partition.path] * len(rows)), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1].decode("utf-8", "replace").removesuffix("\r") for r in rows])]
            return pa.RecordBatch.from_arrays(columns, names=["path", "at", "line"])

        for row in lines_in(fs, partition):
            rows.append(row)
            held += len(row[1])
            if held > 8 * BLOCK or len(rows) == 10_000:
                yield batch()
                rows, held = [], 0
        if rows:
            yield batch()


class WholeReader(Reading, DataSourceReader):
    """All lines that are whole now."""

    def partitions(self) -> list[Lines]:
        fs, _ = opened(self.folder)
        found = self.parts([(p, 0, last_end(fs, p, n)) for p, n in sorted(sizes(self.folder, self.pattern).items())])
        return found or [Lines("", 0, 0, 0)]


class GrowingReader(Reading, DataSourceStreamReader):
    def __init__(self, folder: str, pattern: str, split: int):
        super().__init__(folder, pattern, split)
        self.known: dict[str, tuple[int, int]] = {}  # (size, end) when last looked at

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        fs, _ = opened(self.folder)
        found = sizes(self.folder, self.pattern)
        for path, size in found.items():
            before = self.known.get(path, (-1, 0))
            if before[0] != size:
                self.known[path] = (size, last_end(fs, path, size, before[1]))
        self.known = {p: self.known[p] for p in sorted(found)}
        return {p: end for p, (_, end) in self.known.items() if end}

    def partitions(self, start: dict, end: dict) -> list[Lines]:
        read = {p: start.get(p, 0) for p in end}
        return self.parts([(p, read[p] if read[p] <= e else 0, e) for p, e in sorted(end.items()) if read[p] != e])

    def commit(self, end: dict) -> None:
        pass


class GrowingLines(DataSource):
    """Format ``growing_lines``: (path, at, line) of the files under ``path`` that match ``glob`` (all)."""

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return SCHEMA

    def _arguments(self) -> tuple:
        return self.options["path"], self.options.get("glob", "*"), int(self.options.get("split", SPLIT))

    def reader(self, schema) -> DataSourceReader:
        return WholeReader(*self._arguments())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return GrowingReader(*self._arguments())


def growing_lines(spark: SparkSession, folder: str, glob: str = "*", stream: bool = True, split: int = SPLIT) -> DataFrame:
    """(path, at, line): whole lines of a folder's files as they are written; ``at`` is a line's first byte. Bytes that aren't
    UTF-8 become replacement characters; empty lines are lines; an empty folder, or one not there yet, gives none."""
    spark.dataSource.register(GrowingLines)
    read = spark.readStream if stream else spark.read
    return read.format("growing_lines").option("path", folder).option("glob", glob).option("split", split).load()
