"""Record versions: incarnation, the commit's global version, the record's number in the commit, completeness.

The order is that of the struct's fields; no incarnation comes before any, an incomplete global version is ten FF bytes
and so comes after every complete one of its incarnation."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.prefix import numbered
from cairn.plans.errors import CairnError

GLOBAL_BYTES = 10
MOST_LOCAL = 65_534
INCOMPLETE = b"\xff" * GLOBAL_BYTES


def version(incarnation: Column, global_version: Column | None, local: Column) -> Column:
    """STRUCT<incarnation, global_version, local_version, complete>; without a global version it is incomplete."""
    stamp = F.lit(bytearray(INCOMPLETE)) if global_version is None else F.coalesce(global_version, F.lit(bytearray(INCOMPLETE)))
    complete = F.lit(False) if global_version is None else global_version.isNotNull()
    return F.struct(incarnation.cast("decimal(20,0)").alias("incarnation"), stamp.alias("global_version"), local.cast("int").alias("local_version"), complete.alias("complete"))


def completed(v: Column, global_version: Column) -> Column:
    """The version with the stamp its commit got; a complete one stays."""
    return F.when(v["complete"], v).otherwise(F.struct(v["incarnation"].alias("incarnation"), global_version.alias("global_version"), v["local_version"].alias("local_version"), F.lit(True).alias("complete")))


def with_local_versions(df: DataFrame, commit: Sequence[str], order: Sequence[str], name: str = "local_version") -> DataFrame:
    """Numbers each commit's records from 0 in order; a commit of more than 65,535 records is an error when it is read."""
    n = (F.row_number().over(Window.partitionBy(*commit).orderBy(*order)) - 1).cast("int")
    fits = F.when(F.col(name) > MOST_LOCAL, F.raise_error(F.lit("220 context_no_local_version"))).otherwise(F.col(name))
    return df.withColumn(name, n).withColumn(name, fits.cast("int"))


def with_commits(df: DataFrame, within: Sequence[str], order: Sequence[str], name: str = "commit") -> DataFrame:
    """Deals each group's records, in order, to commits 0, 1, ... that hold as many records as local versions tell apart."""
    rows = numbered(df, within, [F.col(c).asc_nulls_last() for c in order], name)
    return rows.withColumn(name, F.floor(F.col(name) / (MOST_LOCAL + 1)).cast("int"))


class RecordContext:
    """What one commit knows: its local versions, its incarnation, its age."""

    def __init__(self, incarnation: int | None = None):
        self._next, self._incarnation, self._began = 0, incarnation, time.monotonic()

    def claim_local_version(self) -> int:
        if self._next > MOST_LOCAL:
            raise CairnError("context_no_local_version")
        self._next += 1
        return self._next - 1

    def incarnation_version(self) -> int | None:
        return self._incarnation

    def set_incarnation_version(self, value: int) -> None:
        if self._incarnation is not None:
            raise CairnError("context_incarnation_set_twice")
        self._incarnation = value

    def age_milliseconds(self) -> int:
        """Since the context was made; what 64 bits can't hold is an error 221."""
        age = int((time.monotonic() - self._began) * 1000)
        if not 0 <= age < 1 << 63:
            raise CairnError("context_age_overflow")
        return age
