"""WARC archives as a PySpark data source (operator 2).

Writing: each task writes its own files, one gzip member per record, rolled at a size, under a name of its own; the
driver's commit lists the files of the attempts that won in a manifest, so files of lost or repeated attempts are
never read. Each member carries its length in the gzip field that the format reserves for it ("sl").

Reading: the driver plans one partition per file. Predicates on the record type and other headers are pushed down;
a task parses a record's headers first, and where a predicate fails or payloads aren't asked for, it goes on to the
next member without inflating the rest.

Equal payloads: the smallest page_id of each (digest, length) comes from a grouping with map-side minimums; the join
back to the pages is one that Spark can split where one payload holds many rows.

Defined results: null html is an empty payload; a null url has no target header; a null page_id is a response only
where no equal payload has an id; rows that repeat the smallest page_id and payload are all responses; an empty table
gives no rows; other columns don't matter.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, IsNotNull, WriterCommitMessage

from memolake.llm.common import fresh_path, table

SCHEMA = "page_id long, record_type string, target_uri string, payload_digest string, refers_to long, payload_length long, payload binary"
MANIFEST = "_committed.json"
ROLL_BYTES = 64 << 20
DATE = "2024-01-01T00:00:00Z"
HEADERS = ("record_type", "page_id", "target_uri", "payload_digest", "refers_to")
BASE16, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def sha1_base32(payload: Column) -> Column:
    """SHA-1 in bare upper-case base32: 160 bits are four groups of ten hexadecimal or eight base-32 digits."""
    hexa = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(hexa, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), BASE16, BASE32)


def record_bytes(row, date: str = DATE) -> bytes:
    """One record as it stands in an archive, not compressed."""
    ref, page = row["refers_to"], row["page_id"]
    payload = b"" if row["record_type"] == "revisit" else bytes(row["payload"] or b"")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_length']}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page {page}')}>", f"WARC-Date: {date}"]
    if row["target_uri"] is not None:
        head.append("WARC-Target-URI: " + quote(row["target_uri"], safe=":/?#[]@!$&'()*+,;=-._~"))
    if page is not None:
        head.append(f"WARC-Page-ID: {page}")
    head.append(f"WARC-Payload-Digest: sha1:{row['payload_digest']}")
    if row["record_type"] == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page {ref}')}>", f"WARC-Refers-To-Page-ID: {ref}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(http) + len(payload)}", "", ""]
    return "\r\n".join(head).encode() + http + payload + b"\r\n\r\n"


def member(record: bytes, level: int = 1) -> bytes:
    """A gzip member with the skip lengths of the WARC format."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(record) + z.flush()
    total = 24 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, total, len(record)) if max(total, len(record)) < 1 << 32 else b"  " + struct.pack("<HII", 8, 0, 0)
    return b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


@dataclass
class Written(WriterCommitMessage):
    files: list


class WarcWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, rows: Iterator) -> Written:
        files, out, size = [], None, 0
        where, root = fs.FileSystem.from_uri(self.path)
        where.create_dir(root, recursive=True)
        for row in rows:
            if out is None or size >= ROLL_BYTES:
                if out:
                    out.close()
                    files[-1][1] = size
                files.append([f"part-{uuid.uuid4().hex}.warc.gz", 0])
                out, size = where.open_output_stream(f"{root}/{files[-1][0]}", compression=None), 0
            size += out.write(member(record_bytes(row)))
        if out:
            out.close()
            files[-1][1] = size
        return Written(files)

    def commit(self, messages) -> None:
        where, root = fs.FileSystem.from_uri(self.path)
        where.create_dir(root, recursive=True)
        name, before = f"{root}/{MANIFEST}", []
        if where.get_file_info(name).type == fs.FileType.File:
            with where.open_input_stream(name) as f:
                before = json.loads(f.read())
        with where.open_output_stream(name) as f:
            f.write(json.dumps(before + [x for m in messages if m for x in m.files]).encode())

    def abort(self, messages) -> None:
        where, root = fs.FileSystem.from_uri(self.path)
        for m in messages:
            for name, _ in m.files if m else []:
                where.delete_file(f"{root}/{name}")


class Window:
    """Bytes of a file by position; holds one block at a time."""

    def __init__(self, f, block: int = 1 << 20):
        self.f, self.block, self.start, self.data = f, block, 0, b""

    def at(self, pos: int, n: int) -> bytes:
        if pos < self.start or pos + n > self.start + len(self.data):
            self.f.seek(pos)
            self.start, self.data = pos, self.f.read(max(n, self.block))
        return self.data[pos - self.start : pos - self.start + n]


class Record:
    """A record in a gzip member or in a plain file, inflated only as far as it is asked for."""

    def __init__(self, window: Window, pos: int, gz: bool):
        self.w, self.pos, self.gz, self.end, self.out, self.at = window, pos, gz, None, bytearray(), pos
        if gz:
            head = window.at(pos, 24)
            if len(head) == 24 and head[3] & 4 and head[12:14] == b"sl":
                self.end = pos + struct.unpack("<I", head[16:20])[0]
            self.z = zlib.decompressobj(31)

    def upto(self, n: int) -> bytearray:
        while len(self.out) < n and not (self.gz and self.z.eof):
            got = (self.gz and self.z.unconsumed_tail) or self.w.at(self.at, 16384)
            if not got:
                break
            if not (self.gz and self.z.unconsumed_tail):
                self.at += len(got)
            self.out += self.z.decompress(got, n - len(self.out)) if self.gz else got
        return self.out

    def through(self, mark: bytes, start: int = 0) -> int:
        """The place after the mark; what precedes it is inflated."""
        n = max(2048, start)
        while (i := self.upto(n).find(mark, start)) < 0:
            if len(self.out) < n:
                return -1
            n *= 2
        return i + len(mark)

    def next(self, length: int) -> int:
        """Where the next record begins; length: of this one."""
        if not self.gz:
            return self.pos + length
        if self.end is None:
            while not self.z.eof and len(self.upto(len(self.out) + (1 << 20))):
                self.out.clear()
                if not self.z.unconsumed_tail and not self.w.at(self.at, 1) and not self.z.eof:
                    break
            self.end = self.at - len(self.z.unused_data)
        return self.end


def fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines) if v}


def whole(x: str | None) -> int | None:
    return int(x) if x and x.lstrip("-").isdigit() else None


def records(f, gz: bool, tests: list, payloads: bool) -> Iterator[tuple]:
    """Rows of SCHEMA; tests: (column, values or None for any but null)."""
    window, pos = Window(f), 0
    while window.at(pos, 1):
        rec = Record(window, pos, gz)
        start = rec.through(b"\r\n\r\n")
        if start < 0:
            return
        h = fields(bytes(rec.out[:start]))
        length = start + int(h.get("content-length", 0))
        kind = h.get("warc-type")
        uri = h.get("warc-target-uri")
        row = {
            "record_type": kind, "page_id": whole(h.get("warc-page-id")), "target_uri": None if uri is None else unquote(uri),
            "payload_digest": h.get("warc-payload-digest", "").removeprefix("sha1:") or None, "refers_to": whole(h.get("warc-refers-to-page-id")),
        }
        if all(row[c] is not None and (values is None or row[c] in values) for c, values in tests):
            body, said = start, None
            if h.get("content-type", "").startswith("application/http"):
                body = rec.through(b"\r\n\r\n", start)
                said = whole(fields(bytes(rec.out[start:body])).get("content-length"))
            payload = bytes(rec.upto(length)[body:length]) if payloads and kind != "revisit" else None
            yield row["page_id"], kind, row["target_uri"], row["payload_digest"], row["refers_to"], length - body if said is None else said, payload
        pos = rec.next(length + 4)


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payloads: bool):
        self.path, self.payloads, self.tests = path, payloads, []

    def pushFilters(self, filters):
        for x in filters:
            column = x.attribute[0] if len(getattr(x, "attribute", ())) == 1 else None
            if column in HEADERS and isinstance(x, EqualTo):
                self.tests.append((column, {x.value}))
            elif column in HEADERS and isinstance(x, In):
                self.tests.append((column, set(x.value)))
            elif column in HEADERS and isinstance(x, IsNotNull):
                self.tests.append((column, None))
            else:
                yield x

    def partitions(self):
        where, root = fs.FileSystem.from_uri(self.path)
        found = {x.base_name: x for x in where.get_file_info(fs.FileSelector(root, allow_not_found=True)) if x.type == fs.FileType.File}
        names = [x for x in found if x.endswith((".warc", ".warc.gz"))]
        if MANIFEST in found:
            with where.open_input_stream(found[MANIFEST].path) as f:
                names = [x for x, _ in json.loads(f.read())]
        return [InputPartition(x) for x in sorted(names, key=lambda x: -found[x].size)]

    def read(self, partition):
        if partition is None:
            return
        where, root = fs.FileSystem.from_uri(self.path)
        schema = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("target_uri", pa.string()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload_length", pa.int64()), ("payload", pa.binary())])
        rows, held = [], 0
        with where.open_input_file(f"{root}/{partition.value}") as f:
            for row in records(f, partition.value.endswith(".gz"), self.tests, self.payloads):
                rows.append(row)
                held += len(row[-1] or b"")
                if len(rows) >= 2000 or held >= 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


class WarcSource(DataSource):
    """``spark.read.format("warc").option("payloads", "false").load(folder)`` and ``df.write.format("warc")``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payloads", "true") != "false")

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def as_records(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """Rows of SCHEMA: of equal payloads of at least min_bytes the smallest page_id is the response."""
    payload = F.coalesce(F.encode(F.col(html), "UTF-8"), F.lit(b""))
    p = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("target_uri"), payload.alias("payload"))
    p = p.withColumn("payload_digest", sha1_base32(F.col("payload"))).withColumn("payload_length", F.octet_length("payload").cast("long"))
    alike = ["payload_digest", "payload_length"]
    first = p.groupBy(*alike).agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    p = p.join(first, alike, "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")) & (F.col("payload_length") >= min_bytes)
    kind = F.when(again, F.lit("revisit")).otherwise(F.lit("response"))
    return p.select(
        "page_id", kind.alias("record_type"), "target_uri", "payload_digest", F.when(again, F.col("first")).alias("refers_to"),
        "payload_length", F.when(~again, F.col("payload")).alias("payload"),
    )


def write_warc(records_df: DataFrame, path: str) -> None:
    register(records_df.sparkSession)
    records_df.write.format("warc").mode("append").save(path)


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payloads", str(payloads).lower()).load(path)


def op2_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write_warc(as_records(table(spark, sf_dir, "pages").select("page_id", "url", "html")), path)
    # What is read back is measured: lengths and digests of responses come from their payloads.
    full = read_warc(spark, path).where(F.col("record_type") == "response")
    full = full.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), sha1_base32(F.col("payload")).alias("payload_digest"), "record_type", "refers_to")
    again = read_warc(spark, path, payloads=False).where(F.col("record_type") == "revisit")
    return full.union(again.select("page_id", "payload_length", "payload_digest", "record_type", "refers_to"))


OP2_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS x FROM p),
e AS (SELECT page_id, payload_bytes, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(x, 10 * (i // 8) + 1, 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)::INT, 1) FOR i IN range(32)], '') AS payload_digest FROM d),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM e)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to FROM m
"""
