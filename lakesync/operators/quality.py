"""Data-quality checks and redaction over tables."""

from __future__ import annotations

import base64
import itertools
import json
import math
import os
import re
from collections.abc import Mapping, Sequence
from urllib.parse import quote, quote_plus

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from lakesync.functions.cursor import cursor_sort_key
from lakesync.functions.text import (
    has_dangerous_chars, is_masked_name, is_redacted_name, strip_control_chars,
)


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def count_stable(runs: DataFrame, by: Sequence[str], order: str, count: str) -> DataFrame:
    """First and last row count per stream over its runs; stable when they agree."""
    folded = runs.groupBy(*by).agg(
        F.min_by(count, order).alias("first_rows"), F.max_by(count, order).alias("last_rows"),
        F.count("*").alias("runs"),
    )
    return folded.withColumn("stable", F.col("first_rows") == F.col("last_rows"))


def resume_verdicts(
    ledger: DataFrame, by: Sequence[str], seq: str, read: str, cursor: str, kind: str = "time"
) -> DataFrame:
    """Second run against the first: no more rows read, and the cursor (of one kind) not moved back."""
    def run(number: int, name: str) -> Column:
        return F.max(F.when(F.col(seq) == number, F.col(name)))

    folded = ledger.groupBy(*by).agg(
        run(1, read).alias("first_read"), run(2, read).alias("second_read"),
        run(1, cursor).alias("first_cursor"), run(2, cursor).alias("second_cursor"),
    )
    first, second = (
        F.struct(*cursor_sort_key(F.col(f"{n}_cursor"), ledger.schema[cursor].dataType, kind)) for n in ("first", "second")
    )
    both = F.col("first_cursor").isNotNull() & F.col("second_cursor").isNotNull()
    verdict = (F.col("second_read") <= F.col("first_read")) & both & (second >= first)
    return folded.withColumn("resumes", F.coalesce(verdict, F.lit(False)))


def strip_metadata(df: DataFrame, prefix: str = "_sync_") -> DataFrame:
    return df.drop(*(c for c in df.columns if c.startswith(prefix)))


def secret_forms(value: str) -> list[str]:
    """The spellings a secret can leak in: as it is, base64, percent-encoded, inside JSON text."""
    coded = base64.b64encode(value.encode()).decode()
    quoted = json.dumps(value, ensure_ascii=False)[1:-1]
    for mark in "<>&":
        quoted = quoted.replace(mark, f"\\u{ord(mark):04x}")
    forms = [value, coded, coded.rstrip("="), quote_plus(value), quote(value, safe="$&+,/:;=@"), quoted]
    return list(dict.fromkeys(forms))


_PLAIN = re.compile(r"[A-Za-z0-9\x80-\U0010ffff]")
#: A choice between more than so many characters is made by classes of characters first.
FEW = 8


def _literal(text: str) -> str:
    return "".join(c if _PLAIN.match(c) else "\\" + c for c in text)


def choice_pattern(words: Sequence[str]) -> str:
    """A regular expression that matches the longest of ``words`` at a place.

    Words with a common beginning share it, so that a place in a text costs a few comparisons however many words there are.
    """
    begin = os.path.commonprefix(words)
    rest = sorted({w[len(begin):] for w in words})
    ends_here, rest = rest[0] == "", [w for w in rest if w]
    if not rest:
        return _literal(begin)
    by_first = {c: [w for w in group] for c, group in itertools.groupby(rest, key=lambda w: w[0])}
    firsts = list(by_first)
    size = len(firsts) if len(firsts) <= FEW else math.ceil(math.sqrt(len(firsts)))
    options = []
    for at in range(0, len(firsts), size):
        some = firsts[at:at + size]
        inner = "|".join(choice_pattern(by_first[c]) for c in some)
        options.append(inner if size == len(firsts) else f"(?=[{''.join(map(_literal, some))}])(?:{inner})")
    return f"{_literal(begin)}(?:{'|'.join(options)}){'?' if ends_here else ''}"


def scan_secrets(df: DataFrame, text: str, secrets: Mapping[str, str]) -> DataFrame:
    """Rows whose whole text contains a known secret in any of its forms, with the names of those found.

    All forms are looked for in one walk over the text, whatever their number: at every place the longest form that begins
    there is found, and with it those that are its beginning.  Blank values never match.
    """
    known = {name: value for name, value in secrets.items() if value.strip()}
    if not known:
        return df.withColumn("found", F.expr("array()").cast("array<string>")).where("false")
    names: dict[str, set[str]] = {}
    for name, value in known.items():
        forms = secret_forms(value)
        # A form that holds another one is found wherever that one is.
        for form in forms:
            if not any(other != form and other in form for other in forms):
                names.setdefault(form, set()).add(name)
    # Names of every form and of the forms it begins with.
    within = {form: sorted(set().union(*(names[form[:k]] for k in range(1, len(form) + 1) if form[:k] in names))) for form in names}
    listed = F.from_json(F.lit(json.dumps(within)), "map<string,array<string>>")
    hits = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(f"(?=({choice_pattern(sorted(names))}))"), F.lit(1)))
    marked = df.withColumn("__forms", hits).where(F.size("__forms") > 0)
    found = F.array_sort(F.array_distinct(F.flatten(F.transform("__forms", lambda f: F.element_at(listed, f)))))
    return marked.withColumn("found", found).drop("__forms")


def mask_sensitive(df: DataFrame) -> DataFrame:
    """``***`` instead of the values of columns whose name holds a sensitive marker."""
    return df.select(
        *(F.lit("***").alias(c) if is_masked_name(c) else F.col(f"`{c}`") for c in df.columns)
    )


def clean_text(df: DataFrame, text: str) -> DataFrame:
    """Text without control and invisible characters, and what the checks said about it."""
    col = F.col(text)
    clean = strip_control_chars(col)
    return df.withColumns(
        {"clean_text": clean, "was_dirty": clean != col, "is_rejected": has_dangerous_chars(col)}
    )


def redact_columns(df: DataFrame) -> DataFrame:
    """Typed redaction: a sensitive field keeps only nulls and gains ``<field>_redacted``."""
    return df.select(*_redacted_fields(df.schema, lambda name: F.col(f"`{name}`")))


def _redacted_fields(schema: T.StructType, get) -> list[Column]:
    out = []
    for field in schema.fields:
        col = get(field.name)
        if is_redacted_name(field.name):
            out.append(F.when(col.isNotNull(), F.lit(True)).alias(f"{field.name}_redacted"))
        else:
            out.append(_redacted_value(col, field.dataType).alias(field.name))
    return out


def _redacted_value(col: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.StructType):
        return F.when(col.isNotNull(), F.struct(*_redacted_fields(dtype, col.getField)))
    if isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, (T.StructType, T.ArrayType)):
        return F.transform(col, lambda v: _redacted_value(v, dtype.elementType))
    return col


@F.pandas_udf(T.StringType())
def redact_json(body: pd.Series) -> pd.Series:
    """Redaction of JSON text of unknown shape, whole text per row."""
    def walk(value):
        if isinstance(value, dict):
            return {
                (f"{k}_redacted" if hidden else k): (True if hidden else walk(v))
                for k, v in value.items()
                for hidden in (v is not None and is_redacted_name(k),)
            }
        return [walk(v) for v in value] if isinstance(value, list) else value

    return body.map(
        lambda text: json.dumps(walk(json.loads(text)), separators=(",", ":"), ensure_ascii=False),
        na_action="ignore",
    )
