"""Schemas of landed records: inference, validation, drift and derived sync modes."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from lakesync.operators.extract import ARRAY, OBJECT

# Fixed value: text of this form is typed as a timestamp.
TIMESTAMP_TEXT = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2})?(\.\d+)?(Z|[+-]\d{2}:?\d{2})?)?$"


# Reasons of a violation, after its path.
WRONG_TYPE, NOT_IN_ENUM, NO_MATCH = "value does not match type", "value not in enum", "value does not match pattern"
MISSING, SURPLUS = "required property missing", "additional property not allowed"


def coarse_type(dtype: T.DataType) -> str:
    """Coarse type name of a Spark type."""
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integer"
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "number"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "timestamp"
    if isinstance(dtype, (T.StructType, T.MapType, T.VariantType)):
        return "object"
    if isinstance(dtype, T.ArrayType):
        return "array"
    return "null" if isinstance(dtype, T.NullType) else "string"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def json_kind(value: Column) -> Column:
    """JSON type of a VARIANT value: null, object, array, string, boolean, integer or number."""
    return bind(F.schema_of_variant(value), lambda name: _kind_of(name, value))


def _kind_of(name: Column, value: Column) -> Column:
    number = F.try_variant_get(value, "$", "double")
    whole = (number == F.floor(number)) & (F.abs(number) < F.lit(9.2e18))
    return (
        F.when(name == "VOID", "null")
        .when(name.startswith("OBJECT"), "object")
        .when(name.startswith("ARRAY"), "array")
        .when(name == "STRING", "string")
        .when(name == "BOOLEAN", "boolean")
        .when((name == "BIGINT") | whole, "integer")
        .otherwise("number")
    )


def value_type(value: Column) -> Column:
    """Field type of a VARIANT value; ISO time text counts as timestamp."""
    text = F.try_variant_get(value, "$", "string")
    return bind(
        json_kind(value),
        lambda kind: F.when((kind == "string") & text.rlike(TIMESTAMP_TEXT), "timestamp").otherwise(kind),
    )


def infer_types(df: DataFrame, record: str, order: str, by: Sequence[str] = ()) -> DataFrame:
    """Type of every field of a VARIANT column: the first non-null one in ``order``.

    Values are first counted per field and type, so what is compared afterwards
    is a handful of rows whatever the size of the table.
    """
    fields = df.select(*by, order, F.explode(F.try_variant_get(F.col(record), "$", OBJECT)).alias("field", "value"))
    counted = fields.groupBy(*by, "field", value_type(F.col("value")).alias("type")).agg(
        F.min(order).alias("first_at"), F.count("*").alias("n")
    )
    concrete = F.col("type") != "null"
    return counted.groupBy(*by, "field").agg(
        F.coalesce(F.min_by("type", F.when(concrete, F.col("first_at"))), F.lit("null")).alias("type"),
        F.coalesce(F.max_by("type", F.when(concrete, F.struct("n", "type"))), F.lit("null")).alias("majority_type"),
        F.count_if(concrete).alias("type_count"),
    )


def catalog_of(spark: SparkSession, tables: Mapping[str, DataFrame], cursors: Mapping[str, str] | None = None) -> DataFrame:
    """One row per table and column with coarse type and position (schema only, no data read)."""
    rows = [
        (name, f.name, coarse_type(f.dataType), i + 1, (cursors or {}).get(name) == f.name)
        for name, df in tables.items() for i, f in enumerate(df.schema.fields)
    ]
    return spark.createDataFrame(
        rows, "table_name string, column_name string, type string, ordinal int, is_cursor boolean"
    )


def verified_keys(tables: Mapping[str, DataFrame], keys: Mapping[str, Sequence[str]]) -> DataFrame:
    """Key columns of the tables whose candidate key is unique and never null."""
    found = []
    for name, columns in keys.items():
        counted = tables[name].groupBy(*columns).agg(F.count("*").alias("n"))
        any_null = reduce(lambda a, b: a | b, (F.col(c).isNull() for c in columns))
        proof = counted.agg((F.max("n") == 1).alias("unique"), F.bool_or(any_null).alias("has_null"))
        found.append(
            proof.where(F.col("unique") & ~F.col("has_null")).select(
                F.lit(name).alias("table_name"), F.explode(F.array(*map(F.lit, columns))).alias("column_name")
            )
        )
    return reduce(DataFrame.unionByName, found)


def schema_drift(snapshot: DataFrame, live: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Field by field change of ``(field, type)`` tables; removed and retyped fields break."""
    joined = snapshot.withColumnRenamed("type", "snapshot_type").join(
        live.withColumnRenamed("type", "live_type"), [*by, "field"], "full"
    )
    change = (
        F.when(F.col("live_type").isNull(), "removed").when(F.col("snapshot_type").isNull(), "added")
        .when(F.col("live_type") != F.col("snapshot_type"), "retyped").otherwise("same")
    )
    return joined.withColumn("change", change).withColumn(
        "breaking", F.col("change").isin("removed", "retyped")
    )


def undeclared_fields(declared: DataFrame, catalog: DataFrame) -> DataFrame:
    """Declared key and cursor fields ``(stream, role, field)`` that the catalog ``(stream, field)`` lacks."""
    return declared.join(catalog.select("stream", "field"), ["stream", "field"], "left_anti")


def derived_sync_modes(streams: DataFrame) -> DataFrame:
    """Modes each stream supports, from its ``has_key`` and ``has_cursor`` flags."""
    key, cursor = F.col("has_key"), F.col("has_cursor")
    modes = F.array_compact(
        F.array(
            F.lit("full_refresh_append"), F.lit("full_refresh_overwrite"),
            F.when(key, "full_refresh_overwrite_deduped"), F.when(cursor, "incremental_append"),
            F.when(key & cursor, "incremental_append_deduped"),
        )
    )
    return streams.withColumn("sync_mode", F.explode(modes))


def first_violation(value: Column, schema: Mapping, path: Column | str = "") -> Column:
    """First violation of a JSON-schema subset by a VARIANT value, as ``path: reason``; null when valid.

    Checked in this order: type, enum, pattern, object rules (property count,
    required, additional, each property by name), then array items.
    """
    if not schema:
        return F.lit(None).cast("string")
    here = F.lit(path) if isinstance(path, str) else path
    shown = F.lit(path or "/") if isinstance(path, str) else here
    # Type name and members are worked out once per value, not once per check.
    known = F.struct(value.alias("v"), json_kind(value).alias("kind"), F.try_variant_get(value, "$", OBJECT).alias("members"))
    return bind(known, lambda k: _violation_of(k["v"], k["kind"], k["members"], schema, here, shown))


def _violation_of(value: Column, kind: Column, members: Column, schema: Mapping, here: Column, shown: Column) -> Column:
    text = F.try_variant_get(value, "$", "string")
    checks: list[Column] = []
    types = schema.get("type")
    if types:
        types = [types] if isinstance(types, str) else list(types)
        accepted = [*types, "integer"] if "number" in types else types
        checks.append(F.when(~kind.isin(*accepted), F.concat(shown, F.lit(f": {WRONG_TYPE} {types}"))))
    if schema.get("enum"):
        checks.append(F.when(~_in_enum(value, kind, text, schema["enum"]),
                             F.concat(shown, F.lit(f": {NOT_IN_ENUM}"))))
    if schema.get("pattern"):
        bad = (kind == "string") & ~text.rlike(schema["pattern"])
        checks.append(F.when(bad, F.concat(shown, F.lit(f": {NO_MATCH}"))))
    checks += _object_checks(members, schema, here, shown)
    if schema.get("items"):
        elements = F.try_variant_get(value, "$", ARRAY)
        each = F.transform(
            elements,
            lambda v, i: first_violation(v, schema["items"], F.concat(here, F.lit("/"), i.cast("string"))),
        )
        checks.append(F.get(F.array_compact(each), 0))
    return F.coalesce(*checks) if checks else F.lit(None).cast("string")


def _in_enum(value: Column, kind: Column, text: Column, options: Sequence) -> Column:
    number = F.try_variant_get(value, "$", "double")
    hits = [F.lit(False)]
    numbers = [float(o) for o in options if isinstance(o, (int, float)) and not isinstance(o, bool)]
    words = [o for o in options if isinstance(o, str)]
    flags = [str(o).lower() for o in options if isinstance(o, bool)]
    if words:
        hits.append((kind == "string") & text.isin(*words))
    if numbers:
        hits.append(kind.isin("integer", "number") & number.isin(*numbers))
    if flags:
        hits.append((kind == "boolean") & text.isin(*flags))
    if None in options:
        hits.append(kind == "null")
    return F.coalesce(reduce(lambda a, b: a | b, hits), F.lit(False))


def _object_checks(members: Column, schema: Mapping, here: Column, shown: Column) -> list[Column]:
    """Rules for objects; ``members`` is null for every other kind of value, and so is each check."""
    checks, properties = [], schema.get("properties")
    if schema.get("minProperties") is not None:
        few = F.size(members) < schema["minProperties"]
        reason = F.concat(
            shown, F.lit(f": minProperties {schema['minProperties']} not satisfied (got "),
            F.size(members).cast("string"), F.lit(")"),
        )
        checks.append(F.when(members.isNotNull() & few, reason))
    if schema.get("required"):
        missing = F.get(F.array_except(F.array(*map(F.lit, schema["required"])), F.map_keys(members)), 0)
        checks.append(F.concat(here, F.lit("/"), missing, F.lit(f": {MISSING}")))
    if schema.get("additionalProperties") is False:
        declared = F.array(*map(F.lit, properties)) if properties else F.expr("array()").cast("array<string>")
        extra = F.get(F.array_sort(F.array_except(F.map_keys(members), declared)), 0)
        checks.append(F.concat(here, F.lit("/"), extra, F.lit(f": {SURPLUS}")))
    for name in sorted(properties or ()):
        child = F.try_element_at(members, F.lit(name))
        path = F.concat(here, F.lit(f"/{name}"))
        checks.append(F.when(child.isNotNull(), first_violation(child, properties[name], path)))
    return checks


def validate_rows(df: DataFrame, record: str, schema: Mapping, out: str = "violation") -> DataFrame:
    """Add the first violation of each record."""
    return df.withColumn(out, first_violation(F.col(record), schema))
