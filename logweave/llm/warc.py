"""WARC bundles (operator 3): independent Zstandard frames with a footer seek table and an index of records.

A bundle is a row of Zstandard frames, each holding whole records, then a skippable frame with the frames' sizes (the
public seekable format). The index maps a record's identifier to its bundle, frame and offset within the frame, so one
record costs one frame. Bundles lie in the shared folder, under names that no other task attempt uses; only what a
committed attempt wrote is in the index.

Null payloads are empty. Of rows that repeat a page_id each has its own record, of the type that its payload asks for.
Rows without page_id have the identifier `none`; they never stand for others unless no row with the same payload has an
identifier.
"""

from __future__ import annotations

import hashlib
import posixpath
import struct
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import scratch, staged, table, tidy

# Fixed values of the public seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES, BUNDLE_BYTES = 1 << 18, 1 << 26
LEAST_PAYLOAD = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    if urlsplit(uri).scheme in ("", "file"):
        return pafs.LocalFileSystem(), urlsplit(uri).path
    return pafs.FileSystem.from_uri(uri)


class BundleWriter:
    """Appends records to frames and frames to a file; close() adds the seek table."""

    def __init__(self, uri: str, frame_bytes: int = FRAME_BYTES, level: int = 1):
        fs, path = filesystem(uri)
        fs.create_dir(posixpath.dirname(path), recursive=True)
        self.out, self.frame_bytes, self.zstd = fs.open_output_stream(path, compression=None), frame_bytes, zstandard.ZstdCompressor(level=level)
        self.parts: list[bytes] = []
        self.held = self.bytes = 0
        self.table: list[tuple[int, int]] = []

    def add(self, *record: bytes) -> tuple[int, int, int]:
        """Frame, offset within the frame, and length of the record."""
        size = sum(map(len, record))
        if self.held and self.held + size > self.frame_bytes:
            self._frame()
        at = (len(self.table), self.held, size)
        self.parts += record
        self.held += size
        return at

    def _frame(self) -> None:
        packed = self.zstd.compress(b"".join(self.parts))
        self.out.write(packed)
        self.table.append((len(packed), self.held))
        self.bytes += len(packed)
        self.parts, self.held = [], 0

    def close(self) -> None:
        if self.held:
            self._frame()
        rows = b"".join(struct.pack("<II", *x) for x in self.table)
        self.out.write(struct.pack("<II", SKIPPABLE, len(rows) + 9) + rows + struct.pack("<IBI", len(self.table), 0, SEEKABLE))
        self.out.close()


class BundleReader:
    """Frames of a bundle, by the seek table at its end."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        self.file.seek(size - 9)
        count, _, magic = struct.unpack("<IBI", self.file.read(9))
        if magic != SEEKABLE:
            raise ValueError(f"{uri} has no seek table")
        self.file.seek(size - 9 - 8 * count)
        rows = list(struct.iter_unpack("<II", self.file.read(8 * count)))
        self.frames, at = [], 0
        for small, large in rows:
            self.frames.append((at, small, large))
            at += small
        self.zstd = zstandard.ZstdDecompressor()

    def frame(self, k: int) -> bytes:
        at, small, large = self.frames[k]
        self.file.seek(at)
        return self.zstd.decompress(self.file.read(small), max_output_size=large)

    def record(self, frame: int, offset: int, length: int) -> bytes:
        return self.frame(frame)[offset : offset + length]

    def close(self) -> None:
        self.file.close()


def _name(page_id: object) -> str:
    return f"<urn:logweave:page:{'none' if page_id is None else page_id}>"


def _page(name: str) -> int | None:
    tail = name.rsplit(":", 1)[1].rstrip(">")
    return None if tail == "none" else int(tail)


def record_parts(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> tuple[bytes, ...]:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = b"" if revisit else payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_name(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"Content-Length: {len(http) + len(body)}",
    ]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_name(refers_to)}"]
    return ("\r\n".join(lines).encode() + b"\r\n\r\n", http, body, b"\r\n\r\n")


def _headers(block: bytes) -> dict[str, str]:
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in block.decode().split("\r\n")[1:])}


def records(frame: bytes) -> Iterator[tuple[dict[str, str], dict[str, str], memoryview]]:
    """Headers, HTTP headers and payload of each record of a frame."""
    view, at = memoryview(frame), 0
    while at < len(frame):
        end = frame.index(b"\r\n\r\n", at)
        head = _headers(frame[at:end])
        begin, size = end + 4, int(head["content-length"])
        http_end = frame.index(b"\r\n\r\n", begin)
        yield head, _headers(frame[begin:http_end]), view[http_end + 4 : begin + size]
        at = begin + size + 4


def _digest(payload: Column) -> Column:
    """The digest of a payload that may be replaced by a revisit record, else null."""
    return F.when(F.octet_length(payload) >= LEAST_PAYLOAD, F.unhex(F.sha2(payload, 256)))


def revisits(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, payload digest, refers_to) of the rows that another row with an equal payload stands for."""
    payload = F.encode(F.coalesce(html, F.lit("")), "UTF-8")
    facts = pages.select(F.col(key).alias("_id"), _digest(payload).alias("d")).where("d is not null")
    groups = facts.groupBy("d").agg(F.min("_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    found = facts.join(groups.select("d", "first"), "d").where("not (_id <=> first)")
    return found.select("_id", "d", "first").distinct()


def write_bundles(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write a record for each row and return the index (page_id, path, frame, offset, length) as a written table."""
    later = revisits(pages, key, html)
    rows = pages.select(F.col(key).alias("_id"), F.col(url).alias("_url"), F.encode(F.coalesce(html, F.lit("")), "UTF-8").alias("_body")).withColumn("d", _digest(F.col("_body")))
    placed = rows.where("_id is not null").join(later.where("_id is not null"), ["_id", "d"], "left").select("_id", "_url", "_body", "first")
    loose = rows.where("_id is null").join(later.where("_id is null").select("d", "first"), "d", "left").select("_id", "_url", "_body", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        stem, count, writer = f"{folder}/part-{context.partitionId():06d}-{context.taskAttemptId()}", 0, None
        path = ""
        for batch in batches:
            index: list[tuple] = []
            for i in range(batch.num_rows):
                page, link, body, first = (c[i] for c in batch.columns)
                payload = body.as_buffer().to_pybytes()
                if writer is None:
                    path = f"{stem}-{count:04d}.warc.zst"
                    writer, count = BundleWriter(path), count + 1
                page, first = page.as_py(), first.as_py()
                parts = record_parts(page, link.as_py(), payload, hashlib.sha256(payload).hexdigest(), first, first is not None, date)
                index.append((page, path, *writer.add(*parts)))
                if writer.bytes > BUNDLE_BYTES:
                    writer.close()
                    writer = None
            columns = list(zip(*index, strict=True)) if index else [()] * 5
            types = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["page_id", "path", "frame", "offset", "length"])
        if writer is not None:
            writer.close()

    return staged(placed.unionAll(loose).mapInArrow(tidy(run), "page_id long, path string, frame int, offset int, length int"), "warc-index")


def read_bundles(index: DataFrame) -> DataFrame:
    """Every record of the bundles of an index, read back frame by frame."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                reader = BundleReader(path)
                for k in range(len(reader.frames)):
                    rows: list[tuple] = []
                    for head, http, payload in records(reader.frame(k)):
                        seen = head["warc-type"]
                        digest = hashlib.sha256(payload).hexdigest() if seen == "response" else head["warc-payload-digest"].partition(":")[2]
                        size = len(payload) if seen == "response" else int(http["content-length"])
                        rows.append((_page(head["warc-record-id"]), size, digest, seen, _page(head["warc-refers-to"]) if seen == "revisit" else None))
                    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
                reader.close()

    paths = index.select("path").distinct()
    return paths.repartition(max(2, paths.count())).mapInArrow(tidy(run), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_bundles(write_bundles(table(spark, sf_dir, "pages"), scratch(spark, "warc")))


#: DuckDB: sha256 of a text is that of its UTF-8 bytes.
OP3_SQL = """
with p as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
     f as (select payload_digest, min(page_id) as first_id from p where payload_bytes >= 100 group by payload_digest)
select p.page_id, cast(p.payload_bytes as bigint) as payload_bytes, p.payload_digest,
       case when f.first_id is null or f.first_id = p.page_id then 'response' else 'revisit' end as record_type,
       case when f.first_id is null or f.first_id = p.page_id then null else f.first_id end as refers_to
from p left join f on p.payload_digest = f.payload_digest and p.payload_bytes >= 100
"""
