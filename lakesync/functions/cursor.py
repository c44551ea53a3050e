"""Typed cursors.

The order of a cursor is fixed once per stream: time, number or text.  A text
cursor whose values are not all of one kind is refused, because no single sort
order would be right for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from lakesync.functions.values import comparable_text

RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def number_of(text: Column) -> Column:
    """Double of a number text (NaN and infinities included); null for any other text."""
    special = F.lower(text).isin("nan", "inf", "+inf", "-inf", "infinity", "+infinity", "-infinity")
    return F.when(text.rlike(NUMBER) | special, text.try_cast("double"))


def cursor_kind(df: DataFrame, field: str) -> str:
    """``time``, ``number`` or ``text`` for a cursor column; one aggregate when it is text."""
    dtype = df.schema[field].dataType
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "time"
    if isinstance(dtype, T.NumericType):
        return "number"
    text = F.trim(F.col(f"`{field}`"))
    seen = df.where(text != "").agg(
        F.count("*").alias("n"),
        F.count_if(text.rlike(RFC3339)).alias("times"),
        F.count_if(text.rlike(NUMBER)).alias("numbers"),
    ).first()
    if seen.n and seen.times == seen.n:
        return "time"
    if seen.n and seen.numbers == seen.n:
        return "number"
    if seen.times or seen.numbers:
        raise ValueError(
            f"cursor field {field!r} mixes kinds: {seen.times} times, {seen.numbers} numbers, "
            f"{seen.n - seen.times - seen.numbers} other texts"
        )
    return "text"


def cursor_sort_key(col: Column, dtype: T.DataType, kind: str) -> list[Column]:
    """Sort columns for a cursor, weakest last.

    Times given as text get a second key with fraction digits seven to nine,
    which a Spark timestamp cannot hold; numbers get their exact decimal value.
    """
    if not isinstance(dtype, T.StringType):
        return [col]
    text = F.trim(col)
    if kind == "time":
        odd = F.raise_error(F.concat(F.lit("cursor is not a time: "), text)).cast("timestamp")
        moment = F.when(text.rlike(RFC3339) | text.isNull(), F.try_to_timestamp(text)).otherwise(odd)
        digits = F.rpad(F.regexp_extract(text, r"\.(\d+)", 1), 9, "0")
        return [moment, F.substring(digits, 7, 3).cast("int")]
    if kind == "number":
        odd = F.raise_error(F.concat(F.lit("cursor is not a number: "), text)).cast("double")
        number = F.when(text.rlike(NUMBER) | text.isNull(), text.try_cast("double")).otherwise(odd)
        # Second key: integers too wide for a double to tell apart.
        return [number, text.try_cast("decimal(38,9)")]
    return [text]


def cursor_text(col: Column, dtype: T.DataType) -> Column:
    return comparable_text(col, dtype)


def cursor_literal(value: str, dtype: T.DataType) -> Column:
    """A stored cursor as a literal of the column's own type, so the bound is pushed to the scan."""
    if isinstance(dtype, T.StringType):
        return F.lit(value)
    if isinstance(dtype, T.TimestampNTZType):
        return F.lit(value.removesuffix("Z").replace("T", " ")).cast("timestamp_ntz")
    return F.lit(value).cast(dtype)


def required_cursor(col: Column, dtype: T.DataType, field: str) -> Column:
    """Cursor text; a missing or blank cursor fails the job."""
    text = cursor_text(col, dtype)
    missing = F.raise_error(F.lit(f"row without a cursor in {field}")).cast("string")
    if isinstance(dtype, T.StringType):
        return F.when(F.trim(text) != "", text).otherwise(missing)
    return F.coalesce(text, missing)


def not_before(col: Column, dtype: T.DataType, kind: str, bound: str) -> Column:
    """Inclusive lower bound: keeps rows at the bound so a retry cannot lose any."""
    return _compare(col, dtype, kind, bound, inclusive=True)


def strictly_after(col: Column, dtype: T.DataType, kind: str, bound: str) -> Column:
    """Exclusive lower bound."""
    return _compare(col, dtype, kind, bound, inclusive=False)


def _compare(col: Column, dtype: T.DataType, kind: str, bound: str, inclusive: bool) -> Column:
    keys = cursor_sort_key(col, dtype, kind)
    if isinstance(dtype, T.StringType):
        limits = cursor_sort_key(F.lit(bound), dtype, kind)
    else:
        limits = [cursor_literal(bound, dtype)]
    if len(keys) == 1:
        return keys[0] >= limits[0] if inclusive else keys[0] > limits[0]
    later = keys[0] > limits[0]
    tail = keys[1] >= limits[1] if inclusive else keys[1] > limits[1]
    return later | ((keys[0] == limits[0]) & F.coalesce(tail, F.lit(inclusive)))
