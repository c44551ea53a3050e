"""Schema mapping before landing, and schemas found in the data.

A schema mapper is a function from the columns a source has to the columns that land.  A mapped column comes from the source
column that its ``source`` metadata names (or the one of its own name) and is cast to the mapped type, nested fields included.
Types of VARIANT values are found in one merging aggregation; only where a place holds objects as well as other values is
that place looked at again, by itself.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, functions as F, types as T

from lakesync.operators.extract import ANY, ARRAY, OBJECT, is_object

SchemaMapper = Callable[[T.StructType], T.StructType]
SOURCE = "source"


def renamed(names: Mapping[str, str]) -> SchemaMapper:
    """Columns under new names; the others stay."""
    def mapper(schema: T.StructType) -> T.StructType:
        return T.StructType([T.StructField(names.get(f.name, f.name), f.dataType, True, {**f.metadata, SOURCE: f.name}) for f in schema.fields])

    return mapper


def retyped(types: Mapping[type, T.DataType]) -> SchemaMapper:
    """Types exchanged for others, in nested columns too."""
    def mapped(dtype: T.DataType) -> T.DataType:
        if isinstance(dtype, T.StructType):
            return mapper(dtype)
        if isinstance(dtype, T.ArrayType):
            return T.ArrayType(mapped(dtype.elementType))
        return types.get(type(dtype), dtype)

    def mapper(schema: T.StructType) -> T.StructType:
        return T.StructType([T.StructField(f.name, mapped(f.dataType), True, f.metadata) for f in schema.fields])

    return mapper


def in_turn(*mappers: SchemaMapper) -> SchemaMapper:
    """Each mapper after the one before; the source of a column stays the first one's."""
    def mapper(schema: T.StructType) -> T.StructType:
        for one in mappers:
            before = {f.name: f.metadata.get(SOURCE, f.name) for f in schema.fields}
            after = one(schema)
            schema = T.StructType([
                T.StructField(f.name, f.dataType, True, {**f.metadata, SOURCE: before.get(name, name)})
                for f in after.fields for name in (f.metadata.get(SOURCE, f.name) if f.metadata.get(SOURCE) in before else f.name,)])
        return schema

    return mapper


def map_schema(df: DataFrame, mapper: SchemaMapper) -> DataFrame:
    """``df`` with the columns that the mapper makes of its own; a column without a source is null."""
    target = mapper(df.schema)
    names = [f.name for f in target.fields]
    if len(set(names)) < len(names):
        raise ValueError(f"a mapped column name stands twice: {sorted({n for n in names if names.count(n) > 1})}")
    return df.select(*(_field(lambda n: F.col(f"`{n}`"), df.schema, f).alias(f.name) for f in target.fields))


def _field(get: Callable[[str], Column], schema: T.StructType, wanted: T.StructField) -> Column:
    source = wanted.metadata.get(SOURCE, wanted.name)
    if source not in schema.names:
        return F.lit(None).cast(wanted.dataType)
    return _as(get(source), schema[source].dataType, wanted.dataType)


def _as(value: Column, have: T.DataType, want: T.DataType) -> Column:
    if isinstance(have, T.StructType) and isinstance(want, T.StructType):
        return F.when(value.isNotNull(), F.struct(*(_field(value.getField, have, f).alias(f.name) for f in want.fields)))
    if isinstance(have, T.ArrayType) and isinstance(want, T.ArrayType):
        return F.transform(value, lambda v: _as(v, have.elementType, want.elementType))
    return value if have == want else value.cast(want)


def _member(value: Column, name: str, dtype: str = ANY) -> Column:
    """A member of an object by its whole name, dots and quotes included."""
    if '"' in name and "'" in name:
        return F.try_variant_get(F.try_element_at(F.try_variant_get(value, "$", OBJECT), F.lit(name)), "$", dtype)
    mark = "'" if '"' in name else '"'
    return F.try_variant_get(value, f"$[{mark}{name}{mark}]", dtype)


_OBJECT = re.compile(r"`(?:[^`]|``)*`|\bOBJECT<")


def found_type(values: DataFrame, column: str = "v") -> T.DataType:
    """The type that fits all values of a VARIANT column: objects as structs with the fields of all of them.

    Where objects stand beside values that are none, the type is that of the objects.
    """
    values = values.select(F.col(column).alias("v"))
    text = values.agg(F.schema_of_variant_agg("v")).first()[0]
    return _resolved(T.DataType.fromDDL(_OBJECT.sub(lambda m: m[0] if m[0][0] == "`" else "STRUCT<", text)), values)


def _is_open(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.StructType):
        return any(_is_open(f.dataType) for f in dtype.fields)
    return isinstance(dtype, T.VariantType) or isinstance(dtype, T.ArrayType) and _is_open(dtype.elementType)


def _resolved(dtype: T.DataType, values: DataFrame) -> T.DataType:
    """The same type with every place of mixed values looked at again."""
    if not _is_open(dtype):
        return dtype
    if isinstance(dtype, T.StructType):
        return T.StructType([
            T.StructField(f.name, _resolved(f.dataType, values.select(_member(F.col("v"), f.name).alias("v"))))
            for f in dtype.fields])
    if isinstance(dtype, T.ArrayType):
        return T.ArrayType(_resolved(dtype.elementType, values.select(F.explode(F.try_variant_get("v", "$", ARRAY)).alias("v"))))
    objects = values.where(is_object(F.col("v")))
    return T.VariantType() if objects.isEmpty() else found_type(objects)


#: The kinds of a typed envelope whose value is text, in the order in which they are looked for.
TEXT_KINDS = ("S", "N", "B")
FLAG, NOTHING, MEMBERS, ELEMENTS = "BOOL", "NULL", "M", "L"


def _kinds(envelope: T.StructType) -> dict[str, T.DataType]:
    """The plain type of every kind that an envelope was found with; kinds that are not known stay JSON text."""
    out: dict[str, T.DataType] = {}
    for f in envelope.fields:
        if f.name == MEMBERS and isinstance(f.dataType, T.StructType):
            out[f.name] = plain_schema(f.dataType)
        elif f.name == ELEMENTS and isinstance(f.dataType, T.ArrayType):
            inner = f.dataType.elementType
            out[f.name] = T.ArrayType(_plain(inner) if isinstance(inner, T.StructType) else T.StringType())
        elif f.name == FLAG:
            out[f.name] = T.BooleanType()
        elif f.name != NOTHING:
            out[f.name] = T.StringType()
    return out


def _plain(envelope: T.StructType) -> T.DataType:
    """One kind of value: its type.  Several that differ: text, nested ones as JSON.  None but nulls: text."""
    types = list(_kinds(envelope).values())
    return types[0] if types and all(t == types[0] for t in types) else T.StringType()


def plain_schema(envelopes: T.StructType) -> T.StructType:
    """Schema mapper: the columns of items without their typed envelopes; what is no envelope has none."""
    return T.StructType([T.StructField(f.name, _plain(f.dataType)) for f in envelopes.fields if isinstance(f.dataType, T.StructType)])


def _unwrapped(value: Column, envelope: T.StructType) -> Column:
    """The plain value in an envelope of a found type."""
    kinds, target = _kinds(envelope), _plain(envelope)
    parts = []
    known = [k for k in (*TEXT_KINDS, FLAG, MEMBERS, ELEMENTS) if k in kinds]
    for kind in [*known, *(k for k in kinds if k not in known)]:
        at, found = _member(value, kind), envelope[kind].dataType
        if kind in TEXT_KINDS:
            part = _member(value, kind, "string")
        elif kind == FLAG:
            part = _member(value, kind, "boolean")
        elif isinstance(kinds[kind], T.StructType):
            part = F.when(is_object(at), F.struct(*_members(at, found)))
        elif isinstance(kinds[kind], T.ArrayType):
            part = _each(F.filter(_member(value, kind, ARRAY), is_object), found.elementType)
        else:
            part = F.to_json(at)
        if isinstance(target, T.StringType) and not isinstance(kinds[kind], T.StringType):
            part = part.cast("string") if isinstance(kinds[kind], T.BooleanType) else F.to_json(part)
        parts.append(part)
    return F.coalesce(*parts) if parts else F.lit(None).cast(target)


def _each(items: Column, envelope: T.DataType) -> Column:
    return F.transform(items, lambda v: _unwrapped(v, envelope) if isinstance(envelope, T.StructType) else F.to_json(v))


def _members(value: Column, found: T.StructType) -> list[Column]:
    return [_unwrapped(_member(value, f.name), f.dataType).alias(f.name)
            for f in found.fields if isinstance(f.dataType, T.StructType)]


def unwrap_found(bodies: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of typed-envelope items of unknown shape; the columns are those found in all bodies."""
    items = bodies.select(*keep, F.parse_json("body").alias("__item"))
    found = found_type(items, "__item")
    if not isinstance(found, T.StructType):
        raise ValueError("no body holds an item")
    return items.select(*keep, *_members(F.col("__item"), found))
