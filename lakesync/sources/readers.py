"""Readers of landed files, tables and relational databases."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from lakesync.functions.cursor import cursor_literal

IDENTIFIER = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")
DEFAULT_LIMIT = 100

# Path globs: names that end in .csv in any case, and all other names.
CSV_FILES = "*.[cC][sS][vV]"
OTHER_FILES = "{*[!vV],*[!sS][vV],*[!cC][sS][vV],*[!.][cC][sS][vV],[cC][sS][vV],[sS][vV],[vV]}"


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
               files: str | None = None) -> DataFrame:
    """JSON lines; blank lines are skipped and a malformed line fails the read.

    Without a schema each line is one VARIANT column ``record``.
    """
    reader = spark.read.option("mode", "FAILFAST")
    if files:
        reader = reader.option("pathGlobFilter", files)
    if schema is None:
        return reader.option("singleVariantColumn", "record").json(path)
    return reader.schema(schema).json(path)


def read_csv(spark: SparkSession, path: str, columns: Sequence[str], files: str | None = None) -> DataFrame:
    """CSV with a header row; every value is text (an empty one too), a ragged row fails the read."""
    reader = (
        spark.read.option("header", True).option("mode", "FAILFAST").option("multiLine", True).option("escape", '"')
    )
    if files:
        reader = reader.option("pathGlobFilter", files)
    text = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns])).csv(path)
    return text.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in columns))


def read_landing_dir(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """A directory of CSV files and JSON-lines files as one table of text columns."""
    text = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    from_csv = read_csv(spark, path, columns, files=CSV_FILES)
    return from_csv.unionByName(read_jsonl(spark, path, text, files=OTHER_FILES))


def list_folder(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The Parquet tables ``<name>.parquet`` of a landing or warehouse folder by name; only schemas are read."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(root)
    names = sorted(f.getPath().getName() for f in files)
    return {n.removesuffix(".parquet"): spark.read.parquet(f"{path}/{n}") for n in names if n.endswith(".parquet")}


def read_limited(df: DataFrame, limit: int = DEFAULT_LIMIT, order: Sequence[str] = ()) -> DataFrame:
    """First rows of a table; give an order when the same rows must come back every time."""
    if limit <= 0:
        limit = DEFAULT_LIMIT
    return (df.orderBy(*order) if order else df).limit(limit)


def check_identifier(name: str) -> str:
    if not IDENTIFIER.match(name):
        raise ValueError(f"invalid identifier {name!r}")
    return name


def snapshot(df: DataFrame, cursor: str | None = None, lower: str | None = None,
             limit: int = 0, tie: Sequence[str] = ()) -> DataFrame:
    """Table snapshot: rows strictly above the bound, in cursor order.

    The bound is a literal of the column's type, so it reaches the scan as a
    pushed filter, in files and over JDBC alike.
    """
    if cursor:
        check_identifier(cursor)
        if lower:
            df = df.where(F.col(cursor) > cursor_literal(lower, df.schema[cursor].dataType))
        df = df.orderBy(cursor, *tie)
    return df.limit(limit) if limit > 0 else df


def read_jdbc(
    spark: SparkSession, url: str, schema: str, table: str, options: dict[str, str] | None = None,
    split_column: str | None = None, split_from: str | None = None, split_to: str | None = None, splits: int = 1,
) -> DataFrame:
    """A relational table over JDBC, read in parallel ranges of ``split_column``."""
    name = f'"{check_identifier(schema)}"."{check_identifier(table)}"'
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name)
    for key, value in (options or {}).items():
        reader = reader.option(key, value)
    if split_column:
        reader = (
            reader.option("partitionColumn", check_identifier(split_column))
            .option("lowerBound", str(split_from)).option("upperBound", str(split_to))
            .option("numPartitions", str(splits))
        )
    return reader.load()


# Relational type names and the coarse type each one counts as.
RELATIONAL_TYPES = {
    "smallint": "integer", "integer": "integer", "bigint": "integer", "smallserial": "integer",
    "serial": "integer", "bigserial": "integer",
    "numeric": "number", "decimal": "number", "real": "number", "double precision": "number", "money": "number",
    "boolean": "boolean",
    "timestamp without time zone": "timestamp", "timestamp with time zone": "timestamp", "date": "timestamp",
    "time without time zone": "timestamp", "time with time zone": "timestamp",
    "json": "object", "jsonb": "object", "ARRAY": "array",
}


def relational_type(name: Column) -> Column:
    """Coarse type of a relational type name; unknown names are strings."""
    known = F.create_map(*(F.lit(v) for pair in RELATIONAL_TYPES.items() for v in pair))
    return F.coalesce(F.try_element_at(known, name), F.lit("string"))
