"""Guarded read-only SQL over a store's tables."""

from __future__ import annotations

import re

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from lakesync.functions.values import iso_seconds
from lakesync.sources.readers import IDENTIFIER
from lakesync.sources.tables import TableStore

# What a query's text holds besides names and keywords: literals, quoted names and comments.
_TEXT = re.compile(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|--[^\n]*|/\*.*?\*/", re.S)
_QUOTED = re.compile(r"`((?:[^`]|``)*)`")
# Functions that run any static method of the JVM.
_REFLECTION = re.compile(r"(?i)\b(reflect|try_reflect|java_method)\s*\(")
_RUN_ON_FILES = "spark.sql.runSQLOnFiles"


def register_views(store: TableStore) -> list[str]:
    """Every table with a plain name becomes a view; a table without any rows is skipped."""
    views, log = [], store.log()
    for name in store.names(log):
        if IDENTIFIER.match(name) and not name.startswith("_"):
            table = store.read(name, log)
            if not table.isEmpty():
                table.createOrReplaceTempView(name)
                views.append(name)
    return views


def bare(text: str) -> str:
    """The query without literals and comments; quoted names lose their quotes."""
    return _QUOTED.sub(lambda m: m[1] if IDENTIFIER.match(m[1]) else " quoted ", _TEXT.sub(" ", text))


def check_read_only(text: str) -> None:
    """Refuse at once what is empty, holds several statements or calls a method of the JVM."""
    words = bare(text)
    if not words.strip():
        raise ValueError("the query is empty")
    if ";" in words:
        raise ValueError("a query is one statement without ';'")
    called = _REFLECTION.search(words)
    if called:
        raise ValueError(f"{called[1]!r} has no place in a read-only query")


def analyzed(spark: SparkSession, text: str) -> DataFrame:
    """The query as Spark analyzes it; anything but a query over registered views and tables is refused.

    Commands are no part of a query: as the content of a subquery they do not parse, whatever they are.  Files are not
    read by their path while the query is analyzed.
    """
    check_read_only(text)
    before = spark.conf.get(_RUN_ON_FILES)
    spark.conf.set(_RUN_ON_FILES, "false")
    try:
        spark.sql(f"SELECT 1 FROM (\n{text}\n) AS guarded")
        return spark.sql(text)
    except ParseException as error:
        raise ValueError("a query is one SELECT or WITH statement") from error
    finally:
        spark.conf.set(_RUN_ON_FILES, before)


def has_top_level_limit(text: str) -> bool:
    """True when LIMIT stands outside all parentheses, literals, comments and quoted names."""
    flat, before = _QUOTED.sub(" quoted ", _TEXT.sub(" ", text)), None
    while flat != before:
        before, flat = flat, re.sub(r"\([^()]*\)", " ", flat)
    return re.search(r"(?i)(?<![A-Za-z0-9_.])limit\s+(all\b|[0-9])", flat) is not None


_RECURSION = re.compile(r"(?i)\bwith\s+recursive\b")
_LEVEL = re.compile(r"(?i)\bmax\s+recursion\s+level\s+([0-9]+)")
_LEVEL_LIMIT, _ROW_LIMIT = "spark.sql.cteRecursionLevelLimit", "spark.sql.cteRecursionRowLimit"


def check_recursion(text: str, max_depth: int) -> None:
    """A recursive query needs a bound on its depth, and none of its own goes beyond it."""
    words = bare(text)
    if not _RECURSION.search(words):
        return
    if max_depth <= 0:
        raise ValueError("a recursive query needs max_depth")
    stated = max((int(level) for level in _LEVEL.findall(words)), default=0)
    if stated > max_depth:
        raise ValueError(f"the query asks for {stated} levels, more than the {max_depth} that are allowed")


def query(spark: SparkSession, text: str, limit: int = 0, max_depth: int = 0) -> DataFrame:
    """Run a checked query; the limit applies only when the query has none of its own.

    Recursive queries run with ``max_depth`` only: deeper data fails the query, it is not cut off.  The bound is a setting of
    the session, since plans run later; the number of rows is not limited.
    """
    check_recursion(text, max_depth)
    if max_depth > 0:
        spark.conf.set(_LEVEL_LIMIT, max_depth)
        spark.conf.set(_ROW_LIMIT, -1)
    result = analyzed(spark, text)
    return result.limit(limit) if limit > 0 and not has_top_level_limit(text) else result


def normalize_values(df: DataFrame) -> DataFrame:
    """Bytes as text, times as RFC 3339 seconds, wide whole decimals as BIGINT or DOUBLE."""
    columns = []
    for field in df.schema.fields:
        col, dtype = F.col(f"`{field.name}`"), field.dataType
        if isinstance(dtype, T.BinaryType):
            col = F.decode(col, "UTF-8")
        elif isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
            col = iso_seconds(col)
        elif isinstance(dtype, T.DecimalType) and dtype.scale == 0:
            col = col.cast("bigint") if dtype.precision <= 18 else col.cast("double")
        columns.append(col.alias(field.name))
    return df.select(*columns)
