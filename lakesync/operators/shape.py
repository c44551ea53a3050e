"""Declarative shaping of records: projection, filters, computed columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from lakesync.functions.cursor import RFC3339, cursor_kind, number_of, strictly_after
from lakesync.functions.templates import compile_condition, compile_template
from lakesync.functions.values import comparable_text, iso_seconds


def project(df: DataFrame, declared: T.StructType | None) -> DataFrame:
    """Only declared columns, absent ones as null; without a declaration all columns pass."""
    if declared is None:
        return df
    return df.select(
        *(
            F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name)
            for f in declared.fields
        )
    )


def fields_subset(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Requested columns in the order asked; unknown ones are left out."""
    return df.select(*(F.col(f"`{f}`") for f in fields if f in df.columns))


def where_absent(df: DataFrame, field: str) -> DataFrame:
    return df.where(F.col(f"`{field}`").isNull()) if field in df.columns else df


def where_equals(df: DataFrame, wanted: Mapping[str, object]) -> DataFrame:
    """All listed columns equal their value, compared as text; null equals only null."""
    for field, value in wanted.items():
        if field not in df.columns:
            have = F.lit(None).cast("string")
        else:
            have = comparable_text(F.col(f"`{field}`"), df.schema[field].dataType)
        text = None if value is None else str(value).lower() if isinstance(value, bool) else str(value)
        df = df.where(have.eqNullSafe(F.lit(text)))
    return df


def where_after_cursor(df: DataFrame, field: str, bound: str, kind: str | None = None) -> DataFrame:
    """Strictly after the bound; rows without a cursor stay."""
    col, dtype = F.col(f"`{field}`"), df.schema[field].dataType
    return df.where(col.isNull() | strictly_after(col, dtype, kind or cursor_kind(df, field), bound))


def computed_columns(
    df: DataFrame, templates: Mapping[str, str], config: Mapping[str, str] | None = None,
    declared: T.StructType | None = None,
) -> DataFrame:
    """Add template columns, read from the row as it came, over the projected columns.

    A template whose bare path does not exist adds no column.
    """
    made = {n: compile_template(t, df.schema, config) for n, t in templates.items()}
    made = {n: c for n, c in made.items() if c is not None}
    names = df.columns if declared is None else [f.name for f in declared.fields]
    kept = [
        F.col(f"`{n}`") if n in df.columns else F.lit(None).cast(declared[n].dataType).alias(n)
        for n in names if n not in made
    ]
    return df.select(*kept, *(c.alias(n) for n, c in made.items()))


def where_condition(df: DataFrame, condition: str, config: Mapping[str, str] | None = None) -> DataFrame:
    return df.where(compile_condition(condition, df.schema, config))


def parse_bound(text: Column) -> Column:
    """Timestamp of a digits-only, RFC 3339 or date text; anything else is null."""
    digits = F.timestamp_seconds(text.try_cast("bigint"))
    return (
        F.when(text.rlike(r"^-?\d+$"), digits)
        .when(text.rlike(RFC3339), F.try_to_timestamp(text))
        .when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(text))
    )


def normalize_time(df: DataFrame, field: str, form: str, out: str) -> DataFrame:
    """Time text in one form: ``rfc3339`` (as is), ``unix_seconds``, ``date``, ``after_range`` or ``datetime``.

    Text that is no time is listed in ``<out>_error``; ``datetime`` passes it on as it is.
    """
    text = F.col(f"`{field}`")
    no_error = F.lit(None).cast("string")
    moment = parse_bound(text)
    if form == "rfc3339":
        return df.withColumns({out: text, f"{out}_error": no_error})
    if form == "datetime":
        spelled = F.trim(text)
        known = F.when(~spelled.rlike(r"^-?\d+$"), F.date_format(parse_bound(spelled), "yyyy-MM-dd HH:mm:ss"))
        return df.withColumns({out: F.coalesce(known, spelled), f"{out}_error": no_error})
    # The date is the one that is written, in the text's own zone.
    written = F.when(text.rlike(RFC3339) & moment.isNotNull(), F.substring(text, 1, 10))
    shown = {
        "unix_seconds": F.unix_seconds(moment).cast("string"),
        "date": F.coalesce(written, F.date_format(moment, "yyyy-MM-dd")),
        "after_range": F.concat(F.lit(">="), iso_seconds(moment)),
    }
    if form not in shown:
        raise ValueError(f"no time form {form!r}")
    error = F.when(moment.isNull() & text.isNotNull(), F.concat(F.lit("invalid time value: "), text))
    return df.withColumns({out: shown[form], f"{out}_error": error})


RowHook = Callable[[pd.DataFrame], pd.DataFrame]


def map_rows(df: DataFrame, hook: RowHook, schema: T.StructType | str) -> DataFrame:
    """User function over Arrow batches: returns changed rows, leaves out rows to drop."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield hook(batch)

    return df.mapInPandas(run, schema)


# Type ids of a relational change stream, by kind.
BOOL_IDS, INTEGER_IDS, FLOAT_IDS = (16,), (20, 21, 23), (700, 701, 1700)


def decode_text(raw: Column, type_id: Column) -> dict[str, Column]:
    """Typed readings of a text value by its type id; text that does not parse stays text."""
    is_bool, is_int, is_float = (type_id.isin(*ids) for ids in (BOOL_IDS, INTEGER_IDS, FLOAT_IDS))
    as_bool = F.when(is_bool & raw.isNotNull(), raw.isin("t", "true"))
    as_int = F.when(is_int & raw.rlike(r"^[+-]?\d+$"), raw.try_cast("bigint"))
    as_float = F.when(is_float, number_of(raw))
    typed = as_bool.isNotNull() | as_int.isNotNull() | as_float.isNotNull()
    return {"bool_value": as_bool, "int_value": as_int, "float_value": as_float,
            "text_value": F.when(~typed, raw)}
