"""Snapshots of a table: each commit writes a whole new version, then publishes it by one small file.

Readers follow the newest published version; a writer that fails before publishing leaves nothing that is read.  The
version number is the commit's place in the global order, and its 10 bytes are the records' global version."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from cairn.operators.versions import GLOBAL_BYTES


class SnapshotStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        at = self._path(f"{self.path}/published")
        return sorted(int(f.getPath().getName()) for f in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def current(self) -> int | None:
        found = self.versions()
        return found[-1] if found else None

    @staticmethod
    def global_version(number: int) -> bytes:
        return number.to_bytes(GLOBAL_BYTES, "big")

    def read(self, number: int | None = None) -> DataFrame:
        number = self.current() if number is None else number
        if number is None or number not in self.versions():
            raise FileNotFoundError(f"{self.path} has no version {number}")
        return self.spark.read.parquet(f"{self.path}/data/{number:020d}")

    def commit(self, rows: DataFrame | Callable[[int], DataFrame], key: Sequence[str], partition_by: Sequence[str] = (), files: int | None = None) -> int:
        """Writes and publishes the next version, range-partitioned and sorted by key, so that row-group statistics serve range scans.

        Publishing creates a file that must not exist: of two writers of the same version one fails."""
        number = (self.current() or 0) + 1
        df = rows(number) if callable(rows) else rows
        n = files or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        df = df.repartitionByRange(n, *partition_by, *key).sortWithinPartitions(*partition_by, *key)
        df.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{self.path}/data/{number:020d}")
        self._fs.mkdirs(self._path(f"{self.path}/published"))
        self._fs.create(self._path(f"{self.path}/published/{number:020d}"), False).close()
        return number
