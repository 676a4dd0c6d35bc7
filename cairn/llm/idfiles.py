"""Token-id files with a minimal perfect hash index.

Documents in ascending doc_id order fill shards of at most ``shard_bytes`` of text on average; a shard is two files.
``shard-N.ids`` is a 16-byte header (magic, bytes per id) and the raw little-endian ids of its documents, each with its end
id; an id has 2 bytes where the vocabulary allows it and 4 elsewhere.  ``shard-N.mph`` holds the doc_ids and numbers of ids
in order and a minimal perfect hash of the keys: levels of bit arrays, a key being placed on the first level where no other
key of that level has its bit, ranked by the bits before it; each rank has a 32-bit fingerprint of the key, its row and the
offset of its first id.  A key is found by its shard (a search in the shards' key ranges), a constant number of bit probes,
one fingerprint comparison and one read at the stored offset.

A task writes both files of its shard under a temporary name and renames them, so a repeated task leaves the same files.
The texts are shuffled once, compressed, to their shards; they are smaller so than their ids are.

Null texts are empty (one end id); very long texts are whole; rows with equal doc_id follow each other (those with equal
text too, in any order) in one shard or in neighbouring ones, each with its ids, and a shard's index points to its first;
rows without doc_id come first, have no index entry and are read by their place; an empty table gives no shard; other
columns are ignored.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.shared import new_folder, texts, trim, written
from cairn.llm.tokens import encoder, ragged

MAGIC = b"CRNIDS01"
LEVELS = 40


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finalizer (xor-shift and multiply), seeded."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Distinct 64-bit keys to 0..n-1; other keys to -1 or to any rank (the fingerprint tells)."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.ones = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])
        self.base = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left, sizes, levels = keys.astype(np.uint64), [], []
        while len(left):
            if len(sizes) == LEVELS:
                raise ValueError("keys are not distinct")
            size = (2 * len(left) + 63) // 64 * 64
            at = (_mix(left, len(sizes) + 1) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            left = left[~alone[at]]
        return cls(sizes, np.concatenate(levels) if levels else np.zeros(0, "<u8"))

    def ranks(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.astype(np.uint64)
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(todo):
                break
            at = (_mix(keys[todo], level + 1) % np.uint64(size)).astype(np.int64) + self.base[level]
            word, bit = self.bits[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[todo[hit]] = (self.ones[at >> 6] + below)[hit]
            todo = todo[~hit]
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys, 10_007) >> np.uint64(32)).astype("<u4")


def index_bytes(doc_ids: pa.Array, counts: np.ndarray) -> bytes:
    """The .mph file: JSON header, then doc_ids, numbers of ids, bits, and by rank fingerprints, rows and offsets."""
    counts = counts.astype("<i8")
    start, nulls = np.cumsum(counts) - counts, doc_ids.null_count  # rows without doc_id come first
    listed = doc_ids[nulls:].to_numpy().astype("<i8")
    keys, row = np.unique(listed, return_index=True)
    row = row + nulls
    table = PerfectHash.build(keys.view(np.uint64))
    rank = table.ranks(keys.view(np.uint64))
    marks, rows, offsets = np.zeros(len(keys), "<u4"), np.zeros(len(keys), "<i8"), np.zeros(len(keys), "<i8")
    marks[rank], rows[rank], offsets[rank] = fingerprints(keys.view(np.uint64)), row, start[row]
    head = json.dumps({"docs": len(doc_ids), "nulls": nulls, "keys": len(keys), "sizes": table.sizes}).encode()
    return struct.pack("<8sq", MAGIC, len(head)) + head + b"".join(x.tobytes() for x in (listed, counts, table.bits, marks, rows, offsets))


class Shard:
    """Keyed access to one shard; ids are read where the index points."""

    def __init__(self, folder: str, number: int):
        self.fs, path = pyarrow.fs.FileSystem.from_uri(folder)
        self.path = f"{path}/shard-{number:08d}"
        with self.fs.open_input_file(self.path + ".mph") as f:
            data = f.read()
        magic, size = struct.unpack_from("<8sq", data)
        if magic != MAGIC:
            raise ValueError(f"{self.path}.mph is not an index")
        head = json.loads(data[16 : 16 + size])
        at, parts = 16 + size, []
        for n, kind in ((head["docs"] - head["nulls"], "<i8"), (head["docs"], "<i8"), (sum(head["sizes"]) // 64, "<u8"), (head["keys"], "<u4"), (head["keys"], "<i8"), (head["keys"], "<i8")):
            parts.append(np.frombuffer(data, kind, n, at))
            at += n * np.dtype(kind).itemsize
        self.doc_ids, self.counts, bits, self.marks, self.rows, self.offsets = parts
        self.nulls, self.hash = head["nulls"], PerfectHash(head["sizes"], bits)
        self.file = self.fs.open_input_file(self.path + ".ids")
        magic, self.width, _ = struct.unpack("<8sii", self.file.read_at(16, 0))
        if magic != MAGIC:
            raise ValueError(f"{self.path}.ids is not an id file")

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, offset) of each key; -1 where the shard doesn't hold it."""
        keys = np.asarray(keys, np.int64).view(np.uint64)
        rank = self.hash.ranks(keys)
        ok = rank >= 0
        ok[ok] = self.marks[rank[ok]] == fingerprints(keys[ok])
        row, offset = np.full(len(keys), -1, np.int64), np.full(len(keys), -1, np.int64)
        row[ok], offset[ok] = self.rows[rank[ok]], self.offsets[rank[ok]]
        return row, offset

    def ids(self, offset: int, n: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at(n * self.width, 16 + offset * self.width), f"<u{self.width}").astype("<u4")

    def get(self, key: int) -> np.ndarray | None:
        row, offset = (int(x[0]) for x in self.find(np.array([key])))
        return None if row < 0 else self.ids(offset, int(self.counts[row]))

    def every(self, block: int = 1 << 20) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, list[int]]]:
        """(doc_ids, offsets, numbers of ids, crc32) of all rows, found by their keys; documents that lie together are read together."""
        keys, first, again = np.unique(self.doc_ids, return_index=True, return_counts=True)
        row, offset = self.find(keys)
        if (row < 0).any():
            raise ValueError(f"{self.path}.mph has lost keys")
        n, at = self.counts, np.cumsum(self.counts) - self.counts
        # rows of one key follow its first
        offsets = np.concatenate([at[: self.nulls], np.repeat(offset - at[row], again) + at[self.nulls + ragged(first, again)]]).astype(np.int64)
        rows = np.concatenate([np.arange(self.nulls), np.repeat(row, again) + ragged(np.zeros(len(keys), np.int64), again)]).astype(np.int64)
        n = n[rows]
        names = pa.concat_arrays([pa.nulls(self.nulls, pa.int64()), pa.array(np.repeat(keys, again))])
        a = 0
        while a < len(n):
            ends = offsets[a : a + 4096] + n[a : a + 4096]
            together = np.concatenate([[True], offsets[a + 1 : a + len(ends)] == ends[:-1]]).cumprod().astype(bool) & (ends - offsets[a] <= block)
            b = a + max(1, int(together.sum()))
            data = memoryview(self.ids(int(offsets[a]), int(n[a:b].sum()))).cast("B")
            cuts = (4 * np.concatenate([[0], np.cumsum(n[a:b])])).tolist()
            yield names[a:b], offsets[a:b], n[a:b], [zlib.crc32(data[x:y]) for x, y in zip(cuts, cuts[1:])]
            a = b


def _put(fs: pyarrow.fs.FileSystem, path: str, write) -> None:
    """A whole file or none: written under another name, then renamed over what an earlier attempt left."""
    part = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as out:
        write(out)
    if fs.type_name != "local" and fs.get_file_info(path).type != pyarrow.fs.FileType.NotFound:
        fs.delete_file(path)
    fs.move(part, path)


def _write(batches: Iterator[pa.RecordBatch], folder: str, path: str, end_id: int, width: int) -> Iterator[pa.RecordBatch]:
    fs, root = pyarrow.fs.FileSystem.from_uri(folder)
    number = TaskContext.get().partitionId()
    name, doc_ids, counts = f"{root}/shard-{number:08d}", [], []

    def body(out) -> None:
        out.write(struct.pack("<8sii", MAGIC, width, 0))
        for batch in batches:
            for ids, n in encoder(path).encode(batch.column(1)):
                out.write(np.insert(ids, np.cumsum(n), end_id).astype(f"<u{width}"))
                counts.append(n + 1)
            doc_ids.append(batch.column(0))

    _put(fs, name + ".ids", body)
    trim()
    if not sum(map(len, doc_ids)):
        fs.delete_file(name + ".ids")
        return
    keys, n = pa.concat_arrays(doc_ids), np.concatenate(counts)
    _put(fs, name + ".mph", lambda out: out.write(index_bytes(keys, n)))
    known = keys.drop_null()
    yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (number, known[0].as_py() if len(known) else None, known[-1].as_py() if len(known) else None, len(keys), int(n.sum()))], names=["shard", "first_doc", "last_doc", "n_docs", "n_ids"])


def id_width(path: str, end_id: int) -> int:
    """Bytes of an id: 2 if all ids of the vocabulary and the end id fit, else 4."""
    return 2 if max(end_id, *encoder(path).tokenizer.get_vocab(with_added_tokens=True).values()) < 1 << 16 else 4


def write_shards(docs: DataFrame, folder: str, path: str, end_id: int = 2, shards: int | None = None, shard_bytes: int = 256 << 20) -> DataFrame:
    """Writes the files; returns one row per shard: shard, first_doc, last_doc, n_docs, n_ids, start (ids of all before it)."""
    spark = docs.sparkSession
    fs, root = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(root)
    rows, width = texts(docs), id_width(path, end_id)
    if shards is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // shard_bytes))
    # a doc_id that many rows share is spread by its texts
    ordered = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(shards, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    made = written(ordered.mapInArrow(lambda b: _write(b, folder, path, end_id, width), "shard long, first_doc long, last_doc long, n_docs long, n_ids long"), "idfiles-shards")
    before = F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))  # one row per shard
    return made.withColumn("start", F.coalesce(before, F.lit(0)))


def read_shards(shards: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, found by its key and read from its file."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for keys, offset, n, crc in Shard(folder, number).every():
                    yield pa.RecordBatch.from_arrays([keys, pa.array(offset + start), pa.array(n), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, min(shards.count(), int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return shards.select("shard", "start").repartition(n, "shard").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    folder = new_folder(docs.sparkSession, "idfiles")
    return read_shards(write_shards(docs, folder, path, end_id), folder)
