"""Schemas of primary keys and index entries, their rules and their JSON form."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import types as T

from cairn.plans.errors import CairnError

#: Kinds of elements.  Fixed values.
SCALARS = ("string", "double", "float", "integer", "boolean", "bytes", "uuid")
NULLABLE = tuple(f"maybe_{k}" for k in SCALARS)
LISTS = tuple(f"list_of_{k}" for k in SCALARS)
VERSIONSTAMP = "versionstamp"
INDEX_KINDS = (*SCALARS, *NULLABLE, VERSIONSTAMP, *LISTS)

_SPARK = {"string": T.StringType(), "double": T.DoubleType(), "float": T.FloatType(), "integer": T.LongType(), "boolean": T.BooleanType(), "bytes": T.BinaryType(), "uuid": T.BinaryType()}


def spark_type(kind: str) -> tuple[T.DataType, bool]:
    """The column type of an element and whether it may be NULL."""
    if kind == VERSIONSTAMP:
        return T.StructType([T.StructField("incarnation_version", T.LongType()), T.StructField("local_version", T.IntegerType(), False)]), False
    if kind.startswith("list_of_"):
        return T.ArrayType(_SPARK[kind[8:]]), False  # that no element is NULL is checked by value
    return _SPARK[kind.removeprefix("maybe_")], kind.startswith("maybe_")


def _known(elements: Sequence[str], kinds: Sequence[str], error: str) -> tuple[str, ...]:
    for e in elements:
        if e not in kinds:
            raise CairnError(error, f"{e} is no element of this schema")
    return tuple(elements)


@dataclass(frozen=True)
class PrimaryKeySchema:
    elements: tuple[str, ...]

    def __post_init__(self):
        object.__setattr__(self, "elements", _known(self.elements, SCALARS, "primary_key_schema"))
        if not self.elements:
            raise CairnError("primary_key_schema", "a primary key isn't empty")

    def struct(self, names: Sequence[str]) -> T.StructType:
        return T.StructType([T.StructField(n, *spark_type(k)) for n, k in zip(names, self.elements, strict=True)])


@dataclass(frozen=True)
class IndexSchemaKey:
    index: tuple[str, ...]
    primary_key: tuple[str, ...]

    def __post_init__(self):
        object.__setattr__(self, "index", _known(self.index, INDEX_KINDS, "index_schema"))
        object.__setattr__(self, "primary_key", _known(self.primary_key, SCALARS, "index_schema"))
        if not self.index or not self.primary_key:
            raise CairnError("index_schema", "a key has an index element and a primary key element")
        if self.index.count(VERSIONSTAMP) > 1:
            raise CairnError("index_schema", "a key has one versionstamp at most")

    def has_versionstamp(self) -> bool:
        return VERSIONSTAMP in self.index


@dataclass(frozen=True)
class IndexSchemaValue:
    elements: tuple[str, ...]

    def __post_init__(self):
        object.__setattr__(self, "elements", _known(self.elements, INDEX_KINDS, "index_schema"))
        if not self.elements or self.elements.count(VERSIONSTAMP) > 1:
            raise CairnError("index_schema", "a value isn't empty and has one versionstamp at most")

    def has_versionstamp(self) -> bool:
        return VERSIONSTAMP in self.elements


@dataclass(frozen=True)
class IndexSchema:
    key: IndexSchemaKey
    value: IndexSchemaValue | None = None

    def __post_init__(self):
        if self.value and self.key.has_versionstamp() and self.value.has_versionstamp():
            raise CairnError("index_schema", "the versionstamp is in the key or in the value")


def to_json(schema: PrimaryKeySchema | IndexSchema) -> str:
    if isinstance(schema, PrimaryKeySchema):
        return json.dumps({"v": 1, "primary_key": schema.elements})
    value = {"value": schema.value.elements} if schema.value else {}
    return json.dumps({"v": 1, "key": {"index": schema.key.index, "primary_key": schema.key.primary_key}} | value)


def from_json(text: str) -> PrimaryKeySchema | IndexSchema:
    """An unknown version or element, or a missing key, is an error 243."""
    try:
        x = json.loads(text)
        if x["v"] != 1:
            raise ValueError("unknown version")
        if "primary_key" in x:
            return PrimaryKeySchema(tuple(x["primary_key"]))
        value = IndexSchemaValue(tuple(x["value"])) if "value" in x else None
        return IndexSchema(IndexSchemaKey(tuple(x["key"]["index"]), tuple(x["key"]["primary_key"])), value)
    except (ValueError, KeyError, TypeError, CairnError) as e:
        raise CairnError("schema_codec", str(e)) from None


def check_record_key(struct: T.StructType) -> None:
    """A raw record's primary key: not empty, nothing nullable, no lists; nested keys are keys themselves.  Else 230."""
    if not struct.fields:
        raise CairnError("record_key_schema", "a key or a nested key isn't empty")
    for f in struct.fields:
        if f.nullable:
            raise CairnError("record_key_schema", f"{f.name} may be NULL")
        if isinstance(f.dataType, T.StructType):
            check_record_key(f.dataType)
        elif not isinstance(f.dataType, (T.StringType, T.DoubleType, T.FloatType, T.IntegralType, T.BooleanType, T.BinaryType)):
            raise CairnError("record_key_schema", f"{f.name} is a {f.dataType.simpleString()}")


def check_record_key_values(values: tuple, struct: T.StructType) -> None:
    """A key tuple fits a key schema.  Else 231."""
    kinds = ((T.StringType, str), (T.BooleanType, bool), (T.IntegralType, int), (T.DoubleType, float), (T.FloatType, float), (T.BinaryType, (bytes, bytearray)))
    if not isinstance(values, tuple) or len(values) != len(struct.fields):
        raise CairnError("record_key_mismatch", "another number of elements")
    for v, f in zip(values, struct.fields):
        if isinstance(f.dataType, T.StructType):
            check_record_key_values(v, f.dataType)
        elif not any(isinstance(f.dataType, s) and isinstance(v, p) and (p is bool or not isinstance(v, bool)) for s, p in kinds):
            raise CairnError("record_key_mismatch", f"{f.name}: {v!r}")
