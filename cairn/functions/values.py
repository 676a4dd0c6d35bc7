"""Records as self-describing value trees, and their admission under a stored schema.

A record's schema is a Spark StructType whose field metadata may hold ``kind`` (the kind a column was declared with, such
as sint32), ``message`` or ``enum`` (a type's name).  Trees are rows (path, type, value): relational, so a query on them
prunes and pushes down, and recursion is bounded by the schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.plans.descriptor import Definitions, is_evolvable
from cairn.plans.errors import CairnError

#: Tags of Spark types.  Fixed values.
TAGS = {"double": "double", "float": "float", "int": "int32", "bigint": "int64", "boolean": "bool", "string": "string", "binary": "bytes"}


def tag(field: T.StructField) -> str:
    """The type tag of a field: a scalar's kind, message_<Name>, enum_<Name>, map_<tag>, repeated_<tag>."""
    if kind := field.metadata.get("kind"):
        return "message_cairn.v1.UUID" if kind == "uuid" else kind
    if name := field.metadata.get("enum"):
        return f"enum_{name}"
    t = field.dataType
    if isinstance(t, T.ArrayType):
        return f"repeated_{tag(T.StructField(field.name, t.elementType, metadata=field.metadata.get('element', {})))}"
    if isinstance(t, T.MapType):
        return f"map_{tag(T.StructField(field.name, t.valueType, metadata=field.metadata.get('element', {})))}"
    if isinstance(t, T.StructType):
        return f"message_{field.metadata.get('message', field.name)}"
    if t.simpleString() not in TAGS:
        raise ValueError(f"{field.name}: {t.simpleString()} is no record type")
    return TAGS[t.simpleString()]


def _text(c: Column, t: T.DataType) -> Column:
    if isinstance(t, T.BinaryType):
        return F.lower(F.hex(c))
    if isinstance(t, (T.DoubleType, T.FloatType)):
        # conversion through a decimal has no NaN and no infinity: code 242
        return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.raise_error(F.lit("242 value_not_convertible"))).otherwise(c.cast("string"))
    return c.cast("string")


def _element(field: T.StructField) -> T.StructField:
    """The field of a list's elements or of a map's values."""
    t = field.dataType
    return T.StructField(field.name, t.elementType if isinstance(t, T.ArrayType) else t.valueType, metadata=field.metadata.get("element", {}))


def _cells(field: T.StructField, column: Column, path: Column) -> Column:
    """An array of (path, type, value): the field itself, and what is in it."""
    t = field.dataType

    def own(value: Column) -> Column:
        return F.array(F.struct(path.alias("path"), F.lit(tag(field)).alias("type"), value.cast("string").alias("value")))

    if isinstance(t, T.StructType) and "enum" in field.metadata:
        return own(F.concat_ws(":", column["name"], column["number"].cast("string")))
    if isinstance(t, T.StructType):
        return F.concat(own(F.when(column.isNotNull(), F.lit("{}"))), *(_cells(f, column[f.name], F.concat(path, F.lit(f".{f.name}"))) for f in t.fields))
    if isinstance(t, T.ArrayType):
        within = F.transform(column, lambda x, i: _cells(_element(field), x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
        return F.concat(own(F.when(column.isNotNull(), F.lit("[]"))), F.coalesce(F.flatten(within), F.array().cast("array<struct<path:string,type:string,value:string>>")))
    if isinstance(t, T.MapType):
        entries = F.array_sort(F.map_entries(column))
        within = F.transform(entries, lambda e: _cells(_element(field), e["value"], F.concat(path, F.lit("{"), e["key"].cast("string"), F.lit("}"))))
        return F.concat(own(F.when(column.isNotNull(), F.lit("{}"))), F.coalesce(F.flatten(within), F.array().cast("array<struct<path:string,type:string,value:string>>")))
    return own(_text(column, t))


def value_tree(df: DataFrame, key: list[str]) -> DataFrame:
    """key columns, path, type, value: a row for every field of every record, value NULL where a field is unset, and one for every
    element of a list, at path[0], path[1], ..., and every value of a map, at path{key}."""
    cells = F.concat(*(_cells(f, F.col(f"`{f.name}`"), F.lit(f.name)) for f in df.schema.fields))
    return df.select(*key, F.inline(cells))


def tagged(column: Column, field: T.StructField) -> Column:
    """STRUCT<type, value> with the value as it is; fields of structs, elements of lists and values of maps are tagged within."""
    t = field.dataType
    value = column
    if isinstance(t, T.StructType) and "enum" not in field.metadata:
        value = F.when(column.isNotNull(), F.struct(*(tagged(column[f.name], f).alias(f.name) for f in t.fields)))
    elif isinstance(t, T.ArrayType):
        value = F.transform(column, lambda x: tagged(x, _element(field)))
    elif isinstance(t, T.MapType):
        value = F.transform_values(column, lambda _, x: tagged(x, _element(field)))
    return F.struct(F.lit(tag(field)).alias("type"), value.alias("value"))


def _bad_uuid(c: Column, field: T.StructField) -> Column | None:
    """TRUE where a UUID below this field doesn't have 16 bytes; None if it has no UUID."""
    t = field.dataType
    if field.metadata.get("kind") == "uuid":
        return F.coalesce(F.octet_length(c) != 16, F.lit(False))
    if isinstance(t, T.StructType):
        found = [x for f in t.fields if (x := _bad_uuid(c[f.name], f)) is not None]
        return reduce(Column.__or__, found) if found else None
    inner = t.elementType if isinstance(t, T.ArrayType) else t.valueType if isinstance(t, T.MapType) else None
    if inner is None:
        return None
    element = T.StructField(field.name, inner, metadata=field.metadata.get("element", {}))
    if _bad_uuid(F.lit(None).cast(inner), element) is None:
        return None
    return F.coalesce(F.exists(c if isinstance(t, T.ArrayType) else F.map_values(c), lambda x: _bad_uuid(x, element)), F.lit(False))


def _unknown(c: Column, t: T.DataType, stored: T.DataType) -> Column | None:
    """TRUE where a field that the stored type doesn't know is set somewhere below; None if it knows all of them."""
    if isinstance(t, T.StructType) and isinstance(stored, T.StructType):
        known, found = {f.name: f.dataType for f in stored.fields}, []
        for f in t.fields:
            if f.name not in known:
                found.append(F.size(c[f.name]) > 0 if isinstance(f.dataType, (T.ArrayType, T.MapType)) else c[f.name].isNotNull())
            elif (below := _unknown(c[f.name], f.dataType, known[f.name])) is not None:
                found.append(below)
        return F.coalesce(reduce(Column.__or__, (F.coalesce(x, F.lit(False)) for x in found)), F.lit(False)) if found else None
    of = {T.ArrayType: "elementType", T.MapType: "valueType"}.get(type(t))
    if of is None or type(stored) is not type(t):
        return None
    own, theirs = getattr(t, of), getattr(stored, of)
    if _unknown(F.lit(None).cast(own), own, theirs) is None:
        return None
    return F.coalesce(F.exists(c if isinstance(t, T.ArrayType) else F.map_values(c), lambda x: _unknown(x, own, theirs)), F.lit(False))


def admitted(df: DataFrame, stored: T.StructType) -> Column:
    """TRUE for records that the stored schema can hold: fields it doesn't know, at any depth, are unset (NULL or empty), UUIDs have 16 bytes."""
    known, checks = {f.name: f.dataType for f in stored.fields}, []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name not in known:
            empty = F.size(c) <= 0 if isinstance(f.dataType, (T.ArrayType, T.MapType)) else F.lit(False)
            checks.append(c.isNull() | empty)
            continue
        if (extra := _unknown(c, f.dataType, known[f.name])) is not None:
            checks.append(~extra)
        if (bad := _bad_uuid(c, f)) is not None:
            checks.append(~bad)
    return reduce(Column.__and__, checks, F.lit(True))


def admit(df: DataFrame, stored: T.StructType, old: tuple[Definitions, str] | None = None, new: tuple[Definitions, str] | None = None) -> DataFrame:
    """df, of which a record that the stored schema can't hold is an error 241 when it is read.

    Descriptors of the stored message and of the code's, if given, are looked at first: one that can't evolve to the other is a 241 too."""
    if old and new and not is_evolvable(*old, *new):
        raise CairnError("message_not_admitted", f"{old[1]} can't evolve to {new[1]}")
    return df.filter(F.when(admitted(df, stored), True).otherwise(F.raise_error(F.lit("241 message_not_admitted")).cast("boolean")))
