"""Key expressions: the primary key and the index entries of records, as columns.

An expression surface of Spark SQL columns stands for per-record queries; each rule that a per-record tuple has to obey
is checked by a column that raises the rule's code when a row breaks it."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.plans.errors import CairnError
from cairn.plans.schema import INDEX_KINDS, LISTS, SCALARS, VERSIONSTAMP, spark_type

MOST_LOCAL = 65_535


def _raise_if(bad: Column, value: Column, code: str) -> Column:
    return F.when(bad, F.raise_error(F.lit(code))).otherwise(value)


@dataclass(frozen=True)
class Element:
    """A named, typed element of a key or a value."""

    name: str
    kind: str
    value: Column

    def columns(self, code: str) -> list[Column]:
        """One column; a versionstamp gives two, <name>_incarnation and <name>_local."""
        v = self.value
        if self.kind == VERSIONSTAMP:
            local = v["local_version"]
            fits = _raise_if(local.isNull() | (local < 0) | (local > MOST_LOCAL), local, code)
            return [v["incarnation_version"].cast("long").alias(f"{self.name}_incarnation"), fits.cast("int").alias(f"{self.name}_local")]
        kind, _ = spark_type(self.kind)
        out = v.cast(kind)
        if self.kind in LISTS:
            out = _raise_if(v.isNull() | F.exists(v, lambda x: x.isNull()), out, code)
        elif self.kind in SCALARS:
            out = _raise_if(v.isNull(), out, code)
        if self.kind.endswith("uuid") and self.kind not in LISTS:
            out = _raise_if(F.octet_length(out) != 16, out, code)
        return [out.alias(self.name)]


def primary_key(df: DataFrame, elements: Sequence[Element], keep: Sequence[str] = ()) -> DataFrame:
    """The key columns of each record, with the columns in keep.  No NULLs (code 250)."""
    if not elements or any(e.kind not in SCALARS for e in elements):
        raise CairnError("primary_key_expression", "a primary key has scalar elements and isn't empty")
    return df.select(*(c for e in elements for c in e.columns("250 primary_key_expression")), *keep)


@dataclass(frozen=True)
class Index:
    """An index: key elements, optional covering elements, optional fan-out over a repeated field.

    fan_out: an array column (or expression); elements refer to its current element as ``F.col("item")`` and to its place
    as ``F.col("ordinal")``.  An empty or NULL array gives no entry."""

    name: str
    key: tuple[Element, ...]
    value: tuple[Element, ...] = ()
    fan_out: Column | None = field(default=None, compare=False)

    def __post_init__(self):
        if not self.key or any(e.kind not in INDEX_KINDS for e in (*self.key, *self.value)):
            raise CairnError("index_expression", "an index key isn't empty and has known kinds")
        if sum(e.kind == VERSIONSTAMP for e in (*self.key, *self.value)) > 1:
            raise CairnError("index_schema", "an index has one versionstamp at most")

    def entries(self, records: DataFrame, primary: Sequence[str]) -> DataFrame:
        """Key columns, primary key columns, value columns: 0 to n rows of each record, without a shuffle."""
        rows = records
        if self.fan_out is not None:
            rows = rows.select("*", F.posexplode(self.fan_out).alias("ordinal", "item"))
        code = "251 index_expression"
        return rows.select(*(c for e in self.key for c in e.columns(code)), *primary, *(c for e in self.value for c in e.columns(code)))

    def fetch(self, entries: DataFrame, records: DataFrame, primary: Sequence[str], where: Column) -> DataFrame:
        """The records with an entry for which where holds: an index range, then a semi-join on the primary key."""
        return records.join(entries.filter(where).select(*primary).distinct(), list(primary), "left_semi")


def changes(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries to delete, entries to insert) that turn an index's old entries into the new ones."""
    return old.exceptAll(new), new.exceptAll(old)


class Registry:
    """Primary key and index functions by record type: where users extend the engine."""

    def __init__(self):
        self.primary: dict[str, Callable[[DataFrame], DataFrame]] = {}
        self.indexes: dict[str, dict[str, Callable[[DataFrame], DataFrame]]] = {}

    def register(self, record_type: str, primary: Callable[[DataFrame], DataFrame], indexes: Mapping[str, Callable[[DataFrame], DataFrame]]) -> None:
        self.primary[record_type], self.indexes[record_type] = primary, dict(indexes)

    def keys(self, record_type: str, records: DataFrame) -> DataFrame:
        return self.primary[record_type](records)

    def entries(self, record_type: str, records: DataFrame) -> dict[str, DataFrame]:
        return {name: f(records) for name, f in self.indexes[record_type].items()}

