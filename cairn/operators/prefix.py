"""Ranks and running sums over a total order, without bringing all rows to one task.

Rows are range-partitioned and sorted, each partition is summed, and the sums of the partitions before are added: one row
per partition is all that ever meets in one place."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.sources.shared import settled


def running(df: DataFrame, order: Sequence[Column], amount: Column, name: str, partitions: int | None = None) -> DataFrame:
    """df with ``name``: the sum of amount over the rows before each row in the order."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # settled: both uses below must see the same partitions
    dealt = settled(df.repartitionByRange(n, *order).withColumn("_rs_part", F.spark_partition_id()))
    own = Window.partitionBy("_rs_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.withColumn("_rs_amount", amount).withColumn("_rs_own", F.coalesce(F.sum("_rs_amount").over(own), F.lit(0)))
    totals = dealt.groupBy("_rs_part").agg(F.sum(amount).alias("_rs_total"))
    before = Window.orderBy("_rs_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_rs_part", F.coalesce(F.sum("_rs_total").over(before), F.lit(0)).alias("_rs_before"))
    return local.join(F.broadcast(offsets), "_rs_part").withColumn(name, F.col("_rs_before") + F.col("_rs_own")).drop("_rs_part", "_rs_amount", "_rs_own", "_rs_before")


def ranked(df: DataFrame, order: Sequence[Column], name: str = "rn") -> DataFrame:
    """df with the row number, from 1, in a total order."""
    return running(df, order, F.lit(1), name).withColumn(name, (F.col(name) + 1).cast("long"))


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str, partitions: int | None = None) -> DataFrame:
    """df with ``name``: the row's number, from 0, in the order of its group.  No group needs to fit one task: of a group that lies
    in several range partitions, each partition after the first gets an offset, so there are at most as many as partitions."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # settled: both uses below must see the same partitions
    dealt = settled(df.repartitionByRange(n, *group, *order).withColumn("_rs_part", F.spark_partition_id()))
    local = dealt.withColumn("_rs_own", F.row_number().over(Window.partitionBy("_rs_part", *group).orderBy(*order)) - 1)
    totals = dealt.groupBy(*(F.col(g).alias(f"_rs_{i}") for i, g in enumerate(group)), F.col("_rs_part").alias("_rs_in")).agg(F.count("*").alias("_rs_total"))
    before = Window.partitionBy(*(f"_rs_{i}" for i in range(len(group)))).orderBy("_rs_in").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_rs_before", F.sum("_rs_total").over(before)).filter("_rs_before is not null").drop("_rs_total")
    same = reduce(Column.__and__, (F.col(g).eqNullSafe(F.col(f"_rs_{i}")) for i, g in enumerate(group)), F.col("_rs_part") == F.col("_rs_in"))
    out = local.join(F.broadcast(offsets), same, "left").withColumn(name, F.coalesce("_rs_before", F.lit(0)) + F.col("_rs_own"))
    return out.select(*df.columns, name)
