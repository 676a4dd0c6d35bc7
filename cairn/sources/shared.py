"""The folder that driver and executors share, and lineage cuts that survive lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where it is unset, a folder of our own (tests)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _OWN:
            _OWN.append("file://" + tempfile.mkdtemp(prefix="cairn-"))
            atexit.register(shutil.rmtree, _OWN[0][7:], ignore_errors=True)
        found = _OWN[0]
        spark.sparkContext.setCheckpointDir(found)
    return found


def settled(df: DataFrame) -> DataFrame:
    """df with its rows and partitions as they are now, written in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
