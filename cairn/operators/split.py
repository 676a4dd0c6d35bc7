"""Records as chunks: a header row (split_idx -1) with the version, and rows 0.. with at most ``chunk_bytes`` each.

All checks are over rows of one primary key, at most 100 chunks unless a caller with smaller chunks allows more, so they
aggregate with partial sums and one shuffle.  A record has at most ``max_bytes``; readers take its number of chunks, ``most_chunks``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.operators.limits import ScanLimiter
from cairn.operators.prefix import running
from cairn.operators.ranges import compare
from cairn.operators.versions import version
from cairn.plans.errors import CairnError

CHUNK_BYTES, MOST_CHUNKS, HEADER = 100_000, 100, -1
MAX_BYTES = CHUNK_BYTES * MOST_CHUNKS


def split(records: DataFrame, key: Sequence[str], record: str, v: Column | None = None, chunk_bytes: int = CHUNK_BYTES, max_bytes: int | None = None) -> DataFrame:
    """key columns, split_idx, chunk, data_splits, version of the header row and of every chunk.

    An empty record has one empty chunk; a multiple of chunk_bytes has no chunk after it; one of more than max_bytes
    (100 chunks if it isn't given) fails with code 214 when it is read."""
    max_bytes = chunk_bytes * MOST_CHUNKS if max_bytes is None else max_bytes
    v = version(F.lit(None), None, F.lit(0)) if v is None else v
    body = F.coalesce(F.col(record).cast("binary"), F.lit(bytearray()))
    parts = F.transform(F.sequence(F.lit(HEADER), F.col("_n") - 1), lambda i: F.struct(i.alias("i"), F.when(i >= 0, F.substring(F.col("_body"), i * chunk_bytes + 1, F.lit(chunk_bytes))).alias("chunk")))
    rows = records.select(*key, body.alias("_body"), v.alias("_version")).withColumn("_n", _splits(chunk_bytes, max_bytes)).withColumn("_part", F.explode(parts))
    head = F.col("_part.i") == HEADER
    return rows.select(*key, F.col("_part.i").alias("split_idx"), F.col("_part.chunk").alias("chunk"), F.when(head, F.col("_n")).alias("data_splits"), F.when(head, F.lit(0)).alias("header_version"), F.when(head, F.col("_version")).alias("version"))


def _splits(chunk_bytes: int, max_bytes: int) -> Column:
    size = F.octet_length(F.col("_body"))
    n = F.greatest(F.ceil(size / F.lit(chunk_bytes)), F.lit(1)).cast("int")
    return F.when(size > max_bytes, F.raise_error(F.lit("214 save_too_large"))).otherwise(n).cast("int")


def gathered(chunks: DataFrame, key: Sequence[str]) -> DataFrame:
    """Per key: the header, how many chunks there are, their numbers' range, and the chunks in order.

    The chunks of one key are bounded by the format: max_bytes of them."""
    head, body = F.col("split_idx") == HEADER, F.col("split_idx") >= 0
    return chunks.groupBy(*key).agg(
        F.sum(head.cast("int")).alias("heads"),
        F.max(F.when(head, F.struct("header_version", "data_splits", "version"))).alias("head"),
        F.sum(body.cast("int")).alias("n"),
        F.min(F.when(body, F.col("split_idx"))).alias("low"),
        F.max(F.when(body, F.col("split_idx"))).alias("high"),
        F.sum((~(head | body)).cast("int")).alias("strange"),
        F.array_sort(F.collect_list(F.when(body, F.struct("split_idx", "chunk")))).alias("parts"),
    )


def _error(most_chunks: int) -> Column:
    """What is wrong with a gathered key: 211 no header or strange rows, 212 the header or its count, 213 the chunks."""
    bad_head = (F.col("head.header_version") != 0) | F.col("head.data_splits").isNull() | ~F.col("head.data_splits").between(1, most_chunks) | F.col("head.version.global_version").isNull()
    return (
        F.when((F.col("heads") == 0) | (F.col("strange") > 0), 211)
        .when(F.coalesce(bad_head, F.lit(True)), 212)
        .when(F.col("n") != F.col("head.data_splits"), 212)
        .when((F.col("n") == 0) | (F.col("low") != 0) | (F.col("high") != F.col("n") - 1), 213)
    )


def joined(parts: str = "parts") -> Column:
    return F.aggregate(parts, F.lit(bytearray()).cast("binary"), lambda a, x: F.concat(a, x["chunk"]))


def classify(chunks: DataFrame, key: Sequence[str], most_chunks: int = MOST_CHUNKS) -> DataFrame:
    """key and error_code (null: the record is whole)."""
    return gathered(chunks, key).select(*key, _error(most_chunks).alias("error_code"))


def records(chunks: DataFrame, key: Sequence[str], reverse: bool = False, limit: int | None = None, until_corrupt: bool = True, most_chunks: int = MOST_CHUNKS) -> DataFrame:
    """The whole records in key order: key, version, record.  A scan stops before the first broken one, in its direction."""
    if limit is not None and limit <= 0:
        raise CairnError("record_builder_limit", "a record limit is positive")
    order = [F.col(k).desc_nulls_last() if reverse else F.col(k).asc_nulls_first() for k in key]
    if until_corrupt:
        first = classify(chunks, key, most_chunks).filter(F.col("error_code").isNotNull()).select(*key).orderBy(*order).limit(1).collect()
        if first:
            chunks = chunks.filter(compare(key, tuple(first[0]), reverse, False))
    # chunks move once: what is dealt out by key ranges is grouped and sorted where it is
    whole = gathered(chunks.repartitionByRange(*order), key).withColumn("error_code", _error(most_chunks))
    out = whole.filter(F.col("error_code").isNull()).select(*key, F.col("head.version").alias("version"), joined().alias("record")).orderBy(*order)
    return out.limit(limit) if limit else out


def records_within(chunks: DataFrame, key: Sequence[str], limiter: ScanLimiter, reverse: bool = False, limit: int | None = None) -> DataFrame:
    """The records of which every key-value was read before a budget ended the scan; a partial last record is dropped."""
    along = [*(F.col(k).desc_nulls_last() if reverse else F.col(k).asc_nulls_first() for k in key), F.col("split_idx").desc() if reverse else F.col("split_idx").asc()]
    rows = chunks
    if limiter.time_is_up():
        rows = rows.filter(F.lit(False))
    if limiter.key_values is not None:
        rows = rows.orderBy(*along).limit(limiter.left_key_values())
    if limiter.bytes is not None:
        size = F.coalesce(F.octet_length("chunk"), F.lit(0)) + sum((F.octet_length(F.col(k).cast("string")) for k in key), F.lit(0))
        rows = running(rows, along, size, "_before").filter(F.col("_before") < limiter.left_bytes()).drop("_before")
    whole = gathered(rows, key).filter((F.col("heads") == 1) & (F.col("n") == F.col("head.data_splits")))
    order = along[: len(key)]
    out = whole.select(*key, F.col("head.version").alias("version"), joined().alias("record")).orderBy(*order)
    return out.limit(limit) if limit else out


def load(chunks: DataFrame, key: Sequence[str], value: tuple, limiter: ScanLimiter | None = None, most_chunks: int = MOST_CHUNKS):
    """(version, record) of one primary key, None if it has no rows; broken ones raise 211, 212 or 213, a budget 210."""
    mine = chunks
    for k, v in zip(key, value):
        mine = mine.filter(F.col(k) == F.lit(v))
    if limiter is not None:
        rows, size = mine.agg(F.count("*"), F.sum(F.coalesce(F.octet_length("chunk"), F.lit(0)))).first()
        left_rows, left_bytes = limiter.left_key_values(), limiter.left_bytes()
        if limiter.reached() or (left_rows is not None and rows > left_rows) or (left_bytes is not None and (size or 0) > left_bytes):
            raise CairnError("load_limit_reached")
        limiter.charge(rows, size or 0)
    got = gathered(mine, key).withColumn("error_code", _error(most_chunks)).withColumn("record", joined()).select("error_code", F.col("head.version").alias("version"), "record").collect()  # one key
    if not got:
        return None
    if got[0]["error_code"] is not None:
        raise CairnError({211: "load_invalid_primary_key", 212: "load_invalid_header", 213: "load_invalid_content"}[got[0]["error_code"]])
    return got[0]["version"], bytes(got[0]["record"])


def delete(chunks: DataFrame, key: Sequence[str], gone: DataFrame) -> DataFrame:
    """The chunk table without the records whose keys are in gone; missing keys are fine."""
    return chunks.join(gone.select(*key).distinct(), list(key), "left_anti")


def delete_checked(chunks: DataFrame, key: Sequence[str], gone: DataFrame, most_chunks: int = MOST_CHUNKS) -> DataFrame:
    """delete(), but a broken record among them is an error 211."""
    broken = classify(chunks.join(gone.select(*key).distinct(), list(key), "left_semi"), key, most_chunks).filter(F.col("error_code").isNotNull())
    if broken.limit(1).count():
        raise CairnError("load_invalid_primary_key")
    return delete(chunks, key, gone)


def save(chunks: DataFrame, key: Sequence[str], changed: DataFrame, record: str, v: Column | None = None, chunk_bytes: int = CHUNK_BYTES, max_bytes: int | None = None) -> DataFrame:
    """The chunk table with the changed records in place of the old ones of their keys; an old one that is broken is an error 211."""
    new = split(changed, key, record, v, chunk_bytes, max_bytes)
    most_chunks = MOST_CHUNKS if max_bytes is None else -(-max_bytes // chunk_bytes)
    return delete_checked(chunks, key, changed, most_chunks).unionByName(new)

