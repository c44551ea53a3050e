"""Text forms, emptiness, deletion marks and hashes of values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F, types as T

# Columns whose content marks a row as deleted at the source.
DELETION_MARKERS = ("_sync_deleted", "_ab_cdc_deleted_at", "_upstream_deleted", "_deleted")

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOATING = (T.FloatType, T.DoubleType)


def plain_number(col: Column) -> Column:
    """Shortest decimal text of a float or double, without exponent; whole numbers have no point, zero has no sign.

    The digits are those of the value's own text, so different values have different texts.  Values that are no numbers are
    ``NaN``, ``+Inf`` and ``-Inf``.
    """
    text = col.cast("string")
    mantissa = F.regexp_replace(F.split_part(F.abs(col).cast("string"), F.lit("E"), F.lit(1)), "\\.0$", "")
    power = F.split_part(text, F.lit("E"), F.lit(2)).try_cast("int")
    digits = F.replace(mantissa, F.lit("."), F.lit(""))
    whole = F.when(F.length(digits) <= power + 1, F.rpad(digits, power + 1, F.lit("0"))).otherwise(
        F.concat(F.left(digits, power + 1), F.lit("."), F.substr(digits, power + 2))
    )
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    plain = F.when(~F.contains(text, F.lit("E")), mantissa).when(power >= 0, whole).otherwise(small)
    return (
        F.when(F.isnan(col), "NaN").when(col == float("inf"), "+Inf").when(col == float("-inf"), "-Inf").when(col == 0, "0")
        .otherwise(F.concat(F.when(col < 0, "-").otherwise(""), plain))
    )


def comparable_text(col: Column, dtype: T.DataType) -> Column:
    """The text a value is compared and keyed by."""
    if isinstance(dtype, T.StringType):
        return col
    if isinstance(dtype, _FLOATING):
        return plain_number(col)
    if isinstance(dtype, T.DecimalType):
        return col.cast("string")
    if isinstance(dtype, T.TimestampNTZType):
        return iso_micros(col)
    if isinstance(dtype, T.TimestampType):
        return iso_micros(F.to_utc_timestamp(col, F.current_timezone()))
    if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType, T.VariantType)):
        return F.to_json(col)
    return col.cast("string")


def iso_micros(col: Column) -> Column:
    """RFC 3339 text in UTC with six fraction digits, so text order is time order."""
    return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def iso_seconds(col: Column) -> Column:
    return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def is_non_empty(col: Column, dtype: T.DataType) -> Column:
    """False for null, empty text, zero and false; true for anything else."""
    if isinstance(dtype, T.StringType):
        filled = col != ""
    elif isinstance(dtype, _INTEGRAL + _FLOATING + (T.DecimalType,)):
        filled = col != 0
    elif isinstance(dtype, T.BooleanType):
        filled = col
    else:
        filled = col.isNotNull()
    return F.coalesce(filled, F.lit(False))


def deletion_mark(col: Column, dtype: T.DataType) -> Column:
    """One marker column: true, non-blank text other than ``false``, or any other value."""
    if isinstance(dtype, T.BooleanType):
        marked = col
    elif isinstance(dtype, T.StringType):
        marked = ~F.trim(col).isin("", "false")
    else:
        marked = col.isNotNull()
    return F.coalesce(marked, F.lit(False))


def is_deleted(schema: T.StructType) -> Column:
    """True when any deletion marker present in ``schema`` says so."""
    mark = F.lit(False)
    for field in schema.fields:
        if field.name in DELETION_MARKERS:
            mark = mark | deletion_mark(F.col(f"`{field.name}`"), field.dataType)
    return mark


def first_non_blank(candidates: Sequence[tuple[Column, T.DataType]], default: str | None = None) -> Column:
    """First candidate that is neither null nor blank text, else ``default``; one text column."""
    picked = [
        F.when(F.trim(c) != "", c) if isinstance(t, T.StringType) else comparable_text(c, t)
        for c, t in candidates
    ]
    if default is not None:
        picked.append(F.lit(default))
    return F.coalesce(*picked)


def row_hash(schema: T.StructType, columns: Sequence[str]) -> Column:
    """SHA-256 of the canonical text of the given columns, in name order.

    Canonical text is ``name=<text>;`` per column, with ``null`` for nulls and
    JSON quoting for text, so no two different rows share a text.
    """
    return F.sha2(canonical_row(schema, columns), 256)


def canonical_row(schema: T.StructType, columns: Sequence[str]) -> Column:
    parts = []
    for name in sorted(columns):
        dtype = schema[name].dataType
        text = comparable_text(F.col(f"`{name}`"), dtype)
        if isinstance(dtype, (T.StringType, T.TimestampNTZType, T.TimestampType, T.DateType)):
            text = json_quote(text)
        parts += [F.lit(f"{name}="), F.coalesce(text, F.lit("null")), F.lit(";")]
    return F.concat(*parts)


def json_quote(text: Column) -> Column:
    """The JSON string literal of a text column (null stays null)."""
    listed = F.to_json(F.array(text))
    return F.when(text.isNotNull(), _strip_list(listed))


def _strip_list(listed: Column) -> Column:
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def hash_bits(hex_digest: Column) -> Column:
    """First 60 bits of a hex digest as a non-negative BIGINT."""
    return F.conv(F.substring(hex_digest, 1, 15), 16, 10).cast("bigint")
