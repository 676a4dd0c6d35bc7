"""WARC archives: a writer with revisit records, and a reader that salvages what follows damage.

Reading goes from record to record: a gzip member that decompresses to its checksum and holds exactly one record, or a
plain record that begins with a version line, ends where Content-Length says and, for responses, has the payload digest
that its header gives.  Where a check fails, the reader searches for the next gzip magic or version line from which a
whole record passes all checks, yields the bytes in between as a quarantined gap with the reason, and goes on.

Archives are read in windows: memory holds one record, not one file.

Null html is an empty payload; very long ones are written whole; of equal payloads the smallest page_id is the response,
and rows with that page_id all are; a null page_id is always a response; an empty table gives no archive; other columns
are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.shared import new_folder, rows_of, written

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
BLOCK = 1 << 18
LEAD = re.compile(rb"\x1f\x8b\x08|WARC/1\.")


class Record(NamedTuple):
    start: int
    end: int
    headers: dict[str, str]
    payload: bytes


class Gap(NamedTuple):
    start: int
    end: int
    reason: str


class Damaged(Exception):
    pass


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(headers: dict[str, str], payload: bytes, compress: bool = True) -> bytes:
    """One record; compressed, it is a gzip member of its own."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items()) + f"Content-Length: {len(payload)}\r\n\r\n"
    whole = head.encode() + payload + b"\r\n\r\n"
    if not compress:
        return whole
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress(whole) + pack.flush()


def parse(whole: bytes) -> tuple[dict[str, str], bytes, int]:
    """Headers, payload and length of the record that whole begins with."""
    if not whole.startswith(VERSION):
        raise Damaged("no version line")
    end = whole.find(b"\r\n\r\n")
    if end < 0:
        raise Damaged("header without end")
    headers = {}
    for line in whole[:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("header line without colon")
        headers[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    if not headers.get("content-length", "").isdigit():
        raise Damaged("no content length")
    n = int(headers["content-length"])
    payload = whole[end + 4 : end + 4 + n]
    if len(payload) < n or whole[end + 4 + n : end + 8 + n] != b"\r\n\r\n":
        raise Damaged("content length doesn't fit")
    digest = headers.get("warc-payload-digest", "")
    if headers.get("warc-type") == "response" and digest.startswith("sha1:") and digest[5:] != payload_digest(payload):
        raise Damaged("payload digest doesn't fit")
    return headers, payload, end + 8 + n


class Salvage:
    """Records and gaps of one archive, in order of their offsets.  file has read_at(n, offset) and size()."""

    def __init__(self, file):
        self.file, self.size = file, file.size()

    def _read(self, at: int, n: int) -> bytes:
        return self.file.read_at(min(n, self.size - at), at) if at < self.size else b""

    def _member(self, at: int) -> Record:
        unpack, out, pos = zlib.decompressobj(31), [], at
        while not unpack.eof:
            block = self._read(pos, BLOCK)
            if not block:
                raise Damaged("gzip member without end")
            try:
                out.append(unpack.decompress(block))
            except zlib.error as e:
                raise Damaged(f"gzip: {e}") from None
            if pos == at and len(out[0]) >= 7 and not out[0].startswith(VERSION):
                raise Damaged("gzip member without version line")
            pos += len(block)
        pos -= len(unpack.unused_data)
        whole = b"".join(out)
        headers, payload, n = parse(whole)
        if n != len(whole):
            raise Damaged("gzip member holds more than a record")
        return Record(at, pos, headers, payload)

    def _plain(self, at: int) -> Record:
        whole = self._read(at, BLOCK)
        end = whole.find(b"\r\n\r\n")
        if end < 0:
            raise Damaged("header without end")
        length = re.search(rb"(?im)^content-length:[ \t]*(\d+)[ \t]*\r?$", whole[:end] + b"\r\n")
        need = end + 8 + (int(length[1]) if length else 0)
        if need > self.size - at:
            raise Damaged("content length beyond the end")
        if need > len(whole):
            whole += self._read(at + len(whole), need - len(whole))
        headers, payload, n = parse(whole)
        return Record(at, at + n, headers, payload)

    def _at(self, at: int) -> Record:
        lead = self._read(at, 7)
        if lead.startswith(MAGIC):
            return self._member(at)
        if lead == VERSION:
            return self._plain(at)
        raise Damaged("neither gzip member nor version line")

    def _next_valid(self, at: int) -> tuple[int, Record | None]:
        """The next offset from which a whole record passes the checks, and that record."""
        while at < self.size:
            block = self._read(at, BLOCK)
            for m in LEAD.finditer(block):
                try:
                    return at + m.start(), self._at(at + m.start())
                except Damaged:
                    continue
            if at + len(block) >= self.size:
                break
            at += len(block) - 6  # a lead may straddle two blocks
        return self.size, None

    def __iter__(self) -> Iterator[Record | Gap]:
        at = 0
        while at < self.size:
            try:
                record = self._at(at)
            except Damaged as e:
                found, record = self._next_valid(at + 1)
                yield Gap(at, found, str(e))
                if record is None:
                    return
            yield record
            at = record.end


def roles(pages: DataFrame) -> DataFrame:
    """(page_id, mark, first) of the pages that revisit another: the payload's digest, the smallest page_id with an equal payload."""
    marks = pages.select("page_id", F.sha1(F.col("payload")).alias("mark")).filter(F.col("page_id").isNotNull())
    first = marks.groupBy("mark").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).filter(F.col("first") < F.col("last")).select("mark", "first")
    return marks.join(first, "mark").filter(F.col("page_id") > F.col("first")).select("page_id", "mark", "first").distinct()


def _write(batches: Iterator[pa.RecordBatch], folder: str, limit: int) -> Iterator[pa.RecordBatch]:
    fs, root = pyarrow.fs.FileSystem.from_uri(folder)
    task, number, rows, size, out, part = TaskContext.get().partitionId(), 0, 0, 0, None, ""

    def close() -> tuple[str, int, int]:
        out.close()
        name = f"task-{task:08d}-{number:04d}.warc.gz"
        if fs.type_name != "local" and fs.get_file_info(f"{root}/{name}").type != pyarrow.fs.FileType.NotFound:
            fs.delete_file(f"{root}/{name}")
        fs.move(part, f"{root}/{name}")
        return name, rows, size

    done = []
    for batch in batches:
        for piece in rows_of(batch, 256):
            for page, url, payload, first in zip(*(c.to_pylist() for c in piece.columns)):
                if out is None:
                    part = f"{root}/{uuid.uuid4().hex}.part"
                    out, rows, size = fs.open_output_stream(part), 0, 0
                headers = {"WARC-Type": "response" if first is None else "revisit", "WARC-Record-ID": f"<urn:page:{'' if page is None else page}>", "WARC-Target-URI": re.sub(r"\s", "%20", url or "")}
                headers |= {"WARC-Payload-Digest": "sha1:" + payload_digest(payload), "X-Payload-Length": str(len(payload))}
                if first is not None:
                    headers |= {"WARC-Refers-To": f"<urn:page:{first}>", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
                size += out.write(record_bytes(headers, payload if first is None else b""))
                rows += 1
                if size >= limit:
                    done.append(close())
                    number, out = number + 1, None
    if out is not None:
        done.append(close())
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.string(), pa.int64(), pa.int64()))], names=["archive", "records", "bytes"])


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, limit: int = 64 << 20, broadcast_rows: int = 1_000_000) -> DataFrame:
    """Writes the archives of (page_id, url, html); returns one row per archive: archive, records, bytes."""
    fs, root = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(root)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    again = written(roles(rows.filter(F.length("payload") >= min_bytes)), "warc-roles")
    small = again.count() <= broadcast_rows
    marked = rows.withColumn("mark", F.sha1("payload"))  # a page_id may stand for several payloads
    whole = marked.join(F.broadcast(again) if small else again, ["page_id", "mark"], "left").select("page_id", "url", "payload", "first")
    whole = whole.withColumn("first", F.when(F.length("payload") >= min_bytes, F.col("first")))
    return written(whole.mapInArrow(lambda b: _write(b, folder, limit), "archive string, records long, bytes long"), "warc-archives")


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """One row per record and per gap: archive, start, end, gap (reason, null for records), kind, record_id, refers_to, uri, digest, payload_bytes."""
    kinds = [("archive", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("gap", pa.string()), ("kind", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()), ("uri", pa.string()), ("digest", pa.string()), ("payload_bytes", pa.int64())]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                with fs.open_input_file(f"{root}/{name}") as file:
                    for x in Salvage(file):
                        if isinstance(x, Gap):
                            rows.append((name, x.start, x.end, x.reason, *[None] * 6))
                        else:
                            h = x.headers
                            n = h.get("x-payload-length") if h.get("warc-type") == "revisit" else str(len(x.payload))
                            rows.append((name, x.start, x.end, None, h.get("warc-type"), h.get("warc-record-id"), h.get("warc-refers-to"), h.get("warc-target-uri"), h.get("warc-payload-digest", "").removeprefix("sha1:"), int(n) if n and n.isdigit() else None))
                        if len(rows) >= 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), kinds)], names=[k for k, _ in kinds])
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), kinds)], names=[k for k, _ in kinds])

    n = max(1, int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return archives.select("archive").repartition(n, "archive").mapInArrow(read, "archive string, start long, end long, gap string, kind string, record_id string, refers_to string, uri string, digest string, payload_bytes long")


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record; a gap in an archive just written is an error."""
    folder = new_folder(pages.sparkSession, "warc")
    found = read_archives(write_archives(pages, folder, min_bytes), folder)
    found = found.filter(F.when(F.col("gap").isNull(), True).otherwise(F.raise_error(F.concat_ws(" ", F.lit("damaged archive"), "archive", "start", "gap")).cast("boolean")))
    number = lambda c: F.nullif(F.regexp_extract(c, r"^<urn:page:(-?\d*)>$", 1), F.lit("")).cast("long")
    return found.select(number("record_id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), number("refers_to").alias("refers_to"))
