"""Line deduplication with two Bloom filters.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at its ends and with A-Z lower-cased.  Keys of at least
``min_chars`` code points found in at least ``min_docs`` documents keep their lines only in the document with the largest
doc_id that holds them.

1. One pass over the texts writes, per document, the 128-bit digests of its distinct long keys.
2. Each task folds its digests into local once-seen and twice-seen filters and ships their non-zero words; each shard of
   the word range is merged by one task: ``twice |= once & incoming``, then ``once |= incoming``.  A key that two
   documents hold always has all its bits in the twice-seen filter.
3. Only digests that hit the twice-seen filter are shuffled; they are counted exactly and the document that keeps the key is chosen.
4. A second pass over the texts drops the lines.

The filter is probed from a broadcast copy while it is smaller than ``broadcast_bytes`` and by a hash join on the word
index beyond that; likewise the confirmed keys.  Sizes are read before either is chosen.

Null and empty texts are one empty line; very long texts and lines are read whole; rows with equal doc_id are one document
when documents are counted, and each of them keeps its row; rows without doc_id count for no key and lose no line; a line
that several rows of the kept document hold stays in all of them; an empty table gives an empty result; other columns pass
through whatever their names, but for the reserved names that begin with ``_ld_``.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.shared import discard, rows_of, written

_ENDS = b" \t\n\x0b\x0c\r"
SHARD_WORDS = 1 << 17
CHUNK = 1 << 20


def key_of(line: bytes, min_chars: int) -> bytes | None:
    """The key of a UTF-8 line, None if it is too short to matter."""
    key = line.strip(_ENDS).lower()  # bytes.lower() changes A-Z only
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return key


def _digests(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in rows_of(batch):
            out = []
            for text in part.column(1).cast(pa.binary()).to_pylist():
                keys = {xxhash.xxh3_128_digest(k) for line in (text or b"").split(b"\n") if (k := key_of(line, min_chars))}
                out.append(b"".join(keys))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.binary())], names=["doc_id", "keys"])


def _halves(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Both 64-bit halves of packed digests."""
    both = np.frombuffer(b"".join(packed), "<u8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _masks(h: np.ndarray) -> np.ndarray:
    """Four bits of one 64-bit word, from the low bits of the hash; its high bits choose the word."""
    one = np.uint64(1)
    out = np.zeros(len(h), np.uint64)
    for shift in (0, 6, 12, 18):
        out |= one << ((h >> np.uint64(shift)) & np.uint64(63))
    return out


def _pack(words: np.ndarray, pack: zstandard.ZstdCompressor) -> bytes:
    """Byte planes compress well: most bits of a sparse word are 0."""
    return pack.compress(np.ascontiguousarray(words.view(np.uint8).reshape(len(words), -1).T).tobytes())


def _unpack(data: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(width, -1).T).reshape(-1).view(kind)


def _local_filters(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """(shard, word numbers, once-seen words, twice-seen words) of each chunk of digests."""
    pack = zstandard.ZstdCompressor(level=1)
    held: list[bytes] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        h, n = np.unique(_halves(held)[0], return_counts=True)
        at, mask = (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64), _masks(h)
        first = np.flatnonzero(np.diff(at, prepend=-1))
        words = at[first]
        once, twice = np.bitwise_or.reduceat(mask, first), np.bitwise_or.reduceat(np.where(n > 1, mask, np.uint64(0)), first)
        shards = words // SHARD_WORDS
        cuts = np.flatnonzero(np.diff(shards, prepend=-1)).tolist()
        rows = [(int(shards[a]), _pack((words[a:b] % SHARD_WORDS).astype("<u4"), pack), _pack(once[a:b], pack), _pack(twice[a:b], pack)) for a, b in zip(cuts, [*cuts[1:], len(words)])]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["shard", "at", "once", "twice"])

    for batch in batches:
        for x in batch.column(0).to_pylist():
            held.append(x)
            size += len(x)
            if size >= 16 * CHUNK:
                yield from flush()
                held, size = [], 0
    if size:
        yield from flush()


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Twice-seen words of each shard; its rows follow each other, so one shard is held at a time."""
    pack, shard = zstandard.ZstdCompressor(level=1), None
    seen, again = np.zeros(SHARD_WORDS, np.uint64), np.zeros(SHARD_WORDS, np.uint64)

    def out() -> Iterator[pa.RecordBatch]:
        at = np.flatnonzero(again)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (shard, len(at), _pack(at.astype("<u4"), pack), _pack(again[at], pack))], names=["shard", "n", "at", "twice"])

    for batch in batches:
        for number, at, once, twice in zip(*(c.to_pylist() for c in batch.columns)):
            if number != shard:
                yield from out()
                shard = number
                seen[:], again[:] = 0, 0
            at, once, twice = _unpack(at, "<u4"), _unpack(once, "<u8"), _unpack(twice, "<u8")
            again[at] |= twice | (seen[at] & once)
            seen[at] |= once
    yield from out()


def twice_filter(keys: DataFrame, n_keys: int) -> tuple[DataFrame, int]:
    """The twice-seen filter's non-zero words by shard, and the number of bits of a word's number."""
    bits = max(0, (max(1, n_keys) // 4).bit_length())
    if bits > 31 + 17:
        raise ValueError("too many keys for 2^48 filter words")
    local = keys.select("keys").mapInArrow(lambda b: _local_filters(b, bits), "shard long, at binary, once binary, twice binary")
    parts = max(1, min(int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")), (1 << bits) // SHARD_WORDS + 1))
    return written(local.repartition(parts, "shard").sortWithinPartitions("shard").mapInArrow(_merge, "shard long, n long, at binary, twice binary"), "lines-twice"), bits


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard, at, twice in zip(*(c.to_pylist() for c in batch.columns)):
            yield pa.RecordBatch.from_arrays([pa.array(_unpack(at, "<u4").astype(np.int64) + shard * SHARD_WORDS), pa.array(_unpack(twice, "<u8").view(np.int64))], names=["at", "word"])


def suspects(keys: DataFrame, twice: DataFrame, bits: int, broadcast_bytes: int) -> DataFrame:
    """(doc_id, h1, h2) of the digests with all bits in the twice-seen filter."""
    size = 12 * (twice.agg(F.sum("n")).first()[0] or 0)
    joined = size > broadcast_bytes
    if not joined:
        got = twice.select("shard", "at", "twice").collect()  # size bytes at most
        at = np.concatenate([_unpack(r.at, "<u4").astype(np.int64) + r.shard * SHARD_WORDS for r in got]) if got else np.zeros(0, np.int64)
        words = np.concatenate([_unpack(r.twice, "<u8") for r in got]) if got else np.zeros(0, np.uint64)
        order = np.argsort(at)
        sent = keys.sparkSession.sparkContext.broadcast((at[order], words[order]))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in rows_of(batch, 4096):
                packed = part.column(1).to_pylist()
                docs = np.repeat(np.arange(len(packed)), [len(x) // 16 for x in packed])
                h1, h2 = _halves(packed)
                at = (h1 >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h1), np.int64)
                columns = [part.column(0).take(pa.array(docs)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))]
                if joined:
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(at), pa.array(_masks(h1).view(np.int64))], names=["doc_id", "h1", "h2", "at", "mask"])
                elif len(sent.value[0]):
                    mine = _masks(h1)
                    place = np.minimum(np.searchsorted(sent.value[0], at), len(sent.value[0]) - 1)
                    hit = pa.array((sent.value[0][place] == at) & (sent.value[1][place] & mine == mine))
                    yield pa.RecordBatch.from_arrays([c.filter(hit) for c in columns], names=["doc_id", "h1", "h2"])

    if not joined:
        return keys.mapInArrow(probe, "doc_id long, h1 long, h2 long")
    rows = keys.mapInArrow(probe, "doc_id long, h1 long, h2 long, at long, mask long")
    words_of = twice.select("shard", "at", "twice").mapInArrow(_word_rows, "at long, word long")
    return rows.join(words_of, "at").filter(F.col("word").bitwiseAND(F.col("mask")) == F.col("mask")).select("doc_id", "h1", "h2")


def repeated_keys(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, broadcast_bytes: int = 64 << 20) -> tuple[DataFrame, DataFrame]:
    """(h1, h2, keep) of the keys in at least min_docs documents, and (doc_id, h1, h2) of their occurrences and a few more."""
    keys = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lambda b: _digests(b, min_chars), "doc_id long, keys binary"), "lines-keys")
    all_keys, keys = keys, keys.filter(F.length("keys") > 0)
    n = (keys.agg(F.sum(F.length("keys"))).first()[0] or 0) // 16
    twice, bits = twice_filter(keys, n)
    found = written(suspects(keys, twice, bits, broadcast_bytes), "lines-suspects")
    confirmed = found.groupBy("h1", "h2").agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("keep")).filter(F.col("n") >= min_docs).select("h1", "h2", "keep")
    confirmed = written(confirmed, "lines-repeated")
    discard(all_keys, twice)
    return confirmed, found


def line_dedup(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, broadcast_bytes: int = 64 << 20, digest: bool = False) -> DataFrame:
    """docs with dropped lines taken out of text, and _ld_lines, _ld_dropped; with digest, text is the SHA-256 of the kept text."""
    spark = docs.sparkSession
    confirmed, found = repeated_keys(docs, min_chars, min_docs, broadcast_bytes)
    names = docs.columns
    key, text_at = names.index("doc_id"), names.index("text")
    schema = ", ".join(f"`{f.name}` {'string' if f.name == 'text' else f.dataType.simpleString()}" for f in docs.schema) + ", _ld_lines long, _ld_dropped long"
    local = 24 * confirmed.count() <= broadcast_bytes
    if local:
        table = confirmed.toPandas()  # broadcast_bytes at most
        order = np.argsort(table["h1"].to_numpy().view(np.uint64), kind="stable")
        sent = spark.sparkContext.broadcast(tuple(table[c].to_numpy()[order] for c in ("h1", "h2", "keep")))
        rows = docs
        discard(found, confirmed)
    else:
        drops = found.join(confirmed, ["h1", "h2"]).filter(F.col("doc_id") < F.col("keep")).groupBy(F.col("doc_id").alias("_ld_doc")).agg(F.collect_set(F.struct("h1", "h2")).alias("_ld_drops"))
        rows = docs.join(drops, docs["doc_id"] == drops["_ld_doc"], "left").drop("_ld_doc")

    def lookup(digests: list[bytes]) -> list[int | None]:
        """The document that keeps each digest's key; None: the key isn't repeated."""
        h1, h2, keep = (x if i == 2 else x.view(np.uint64) for i, x in enumerate(sent.value))
        a, b = _halves(digests)
        lo, hi = np.searchsorted(h1, a, "left").tolist(), np.searchsorted(h1, a, "right").tolist()
        return [next((int(keep[j]) for j in range(x, y) if h2[j] == b[i]), None) if x < y else None for i, (x, y) in enumerate(zip(lo, hi))]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in rows_of(batch, 512):
                split = [(t or b"").split(b"\n") for t in part.column(text_at).cast(pa.binary()).to_pylist()]
                ids = part.column(key).to_pylist()
                digests = [[xxhash.xxh3_128_digest(k) if (k := key_of(x, min_chars)) else None for x in lines] for lines in split]
                if local:
                    flat = [d for ds in digests for d in ds if d]
                    kept_by = dict(zip(flat, lookup(flat))) if flat and len(sent.value[0]) else {}
                    drop = [[d is not None and (k := kept_by.get(d)) is not None and i is not None and i < k for d in ds] for i, ds in zip(ids, digests)]
                else:
                    drop = [[d in own for d in ds] if own else [False] * len(ds) for ds, own in zip(digests, ({struct.pack("<qq", x["h1"], x["h2"]) for x in own or ()} for own in part.column(len(names)).to_pylist()))]
                kept = [b"\n".join([x for x, d in zip(lines, ds) if not d]) for lines, ds in zip(split, drop)]
                text = pa.array([hashlib.sha256(x).hexdigest() for x in kept]) if digest else pa.array(kept, pa.binary()).cast(pa.string())
                columns = [text if i == text_at else part.column(i) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([len(x) for x in split], pa.int64()), pa.array([sum(x) for x in drop], pa.int64())], names=[*names, "_ld_lines", "_ld_dropped"])

    return rows.mapInArrow(apply, schema)
