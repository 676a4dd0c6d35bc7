"""What the n-gram join leaves on disk while it runs."""

import os

import numpy as np

from cairn.llm import jaccard
from cairn.llm.shared import discard, written


def _shuffle_files(spark):
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for d in dirs for _, _, files in os.walk(d.getPath()) for f in files if f.startswith("shuffle_")}


def test_shuffle_files_go_with_the_write(spark):
    before = _shuffle_files(spark)
    table = written(spark.range(5_000).selectExpr("id % 500 as k").repartition(3).groupBy("k").count(), "disk-test")
    assert not _shuffle_files(spark) - before
    assert table.count() == 500 and table.agg({"count": "sum"}).first()[0] == 5_000
    discard(table)


def test_counts_of_a_task_are_small():
    size = (1 << jaccard.CELLS_BITS) // jaccard.CELL_CHUNKS
    few = np.random.default_rng(1).poisson(1.2, size).astype(np.uint32)
    many = few.copy()
    many[7] = 100_000
    for x in (few, many):
        assert (jaccard._unpacked(jaccard._packed(x)) == x).all()
    assert len(jaccard._packed(few)) < few.nbytes / 8
