"""What the operators of this subpackage have in common: the shared folder, written intermediates, Arrow helpers."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: list[str] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; only where it is unset, a folder of our own (tests)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="cairn-"))
        atexit.register(shutil.rmtree, _OWN[0][7:], ignore_errors=True)
    return _OWN[0]


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared folder; it is deleted when the driver ends."""
    path = f"{shared_dir(spark)}/cairn/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session may be over already; the folder is then the cluster's to clean
        return


def bounded(spark: SparkSession, size: int = 4 << 20) -> None:
    """Batches of at most size bytes to and from Python workers, whatever the rows' lengths: a setting of the session."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def written(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """df as a table written in the shared folder and read again: its lineage is cut and lost executors lose nothing."""
    spark = df.sparkSession
    bounded(spark)
    path = new_folder(spark, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")  # its shuffle files go with the write, not when the driver happens to collect its garbage
    try:
        df.write.parquet(path, compression=codec)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._cairn_folder = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that no later result reads."""
    for df in tables:
        _delete(df.sparkSession, df._cairn_folder)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The two columns an operator reads, a null text as an empty one."""
    bounded(df.sparkSession)
    return df.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def rows_of(batch: pa.RecordBatch, size: int = 1024):
    """Slices of a batch, so that Python objects for a few rows exist at a time."""
    for at in range(0, batch.num_rows, size):
        yield batch.slice(at, size)


def blocks(texts: pa.Array, size: int = 4 << 20) -> Iterator[pa.Array]:
    """Slices of about size bytes of text, of one text at least."""
    texts = texts.cast(pa.large_string()).fill_null("")
    before = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy())])
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(before, before[a] + size, "right")) - 1)
        yield pa.concat_arrays([texts[a:b]])  # offsets that begin at 0
        a = b


def trim() -> None:
    """Gives memory that a finished task no longer needs back to the system: workers are used again by later stages."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def words_split(text: str) -> list[str]:
    """Words [^\\x20\\x09-\\x0D]+ after lower-casing A-Z only."""
    return [w for w in ascii_lower(text).translate(_SPACES).split(" ") if w]


_SPACES = {c: " " for c in range(9, 14)}
_UPPER = {c: c + 32 for c in range(65, 91)}


def ascii_lower(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(_UPPER)


def sized(df: DataFrame, rows: int = 2_000_000) -> DataFrame:
    """A written table of narrow rows, marked for broadcast only while it has at most so many."""
    return F.broadcast(df) if df.count() <= rows else df


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component): for the nodes of edges (a, b), the smallest node that links lead to.

    Large stars and small stars in turn: each round joins nodes with the minimum of their neighbourhood, so paths halve
    and hot nodes are only ever aggregated or joined, never gathered.  Each round's edges are written."""
    own = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), name)

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    last = state(own)
    while last[0]:
        both = own.unionByName(own.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b").distinct()
        # and now the smaller neighbours of each node, with the node itself
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        before, own = own, written(small.filter("a > b").distinct(), name)
        discard(before)
        now = state(own)
        if now == last:
            break
        last = now
    return own.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(own.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
