"""Keyed rows in buckets of their key's hash, changed by rewriting only the buckets that a change meets.

A version of such a table is a folder with a small list, ``layout``: for every bucket the folder its file stands in, which is
that of an earlier version where the bucket has not changed since, and the number of its rows.  The number of buckets follows
the number of rows: when buckets have grown to twice their size, a version is written with twice as many.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

BUCKET = "__bucket"
#: Rows of a bucket when its table is written as a whole.
BUCKET_ROWS = 250_000
LAYOUT = "bucket int, path string, rows bigint, live bigint, buckets int"


@dataclass(frozen=True)
class Part:
    """The rows of one bucket; ``live`` counts those that are not deleted."""

    path: str
    rows: int
    live: int


@dataclass(frozen=True)
class Version:
    """Where the rows of a table stand."""

    path: str
    buckets: int
    parts: dict[int, Part]

    @property
    def rows(self) -> int:
        return sum(p.rows for p in self.parts.values())

    @property
    def live(self) -> int:
        return sum(p.live for p in self.parts.values())

    def paths(self, buckets: Sequence[int] | None = None) -> list[str]:
        return [p.path for b, p in sorted(self.parts.items()) if buckets is None or b in set(buckets)]


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*(F.col(f"`{k}`") for k in keys)), F.lit(buckets)).cast("int")


def load_version(spark: SparkSession, path: str) -> Version:
    """The list of a version: one row per bucket."""
    listed = spark.read.schema(LAYOUT).json(f"{path}/layout").collect()
    parts = {r.bucket: Part(r.path, r.rows, r.live) for r in listed if r.bucket >= 0}
    return Version(path, listed[0].buckets, parts)


def read_version(spark: SparkSession, version: Version, schema: T.StructType, buckets: Sequence[int] | None = None) -> DataFrame:
    """The rows of all buckets, or of some."""
    paths = version.paths(buckets)
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _stored(df: DataFrame, keys: Sequence[str], path: str, buckets: int, live: Column, kept: dict[int, Part]) -> Version:
    """Write rows by bucket, one file each, and the list that names them and the kept ones."""
    spark = df.sparkSession
    placed = df if BUCKET in df.columns else df.withColumn(BUCKET, bucket_of(keys, buckets))
    placed.repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{path}/rows")
    schema = T.StructType([f for f in placed.schema.fields if f.name != BUCKET] + [T.StructField(BUCKET, T.IntegerType())])
    written = spark.read.schema(schema).parquet(f"{path}/rows")
    # At most one row per bucket reaches the driver.
    counts = written.groupBy(BUCKET).agg(F.count("*").alias("rows"), F.count_if(live).alias("live")).collect()
    parts = kept | {r[BUCKET]: Part(f"{path}/rows/{BUCKET}={r[BUCKET]}", r.rows, r.live) for r in counts}
    listed = [(b, p.path, p.rows, p.live, buckets) for b, p in sorted(parts.items())] or [(-1, "", 0, 0, buckets)]
    spark.createDataFrame(listed, LAYOUT).coalesce(1).write.json(f"{path}/layout")
    return Version(path, buckets, parts)


def write_version(df: DataFrame, keys: Sequence[str], path: str, rows: int, live: Column | None = None, bucket_rows: int | None = None) -> Version:
    """A first version, or one that replaces all rows; ``rows`` is about their number."""
    size = bucket_rows or BUCKET_ROWS
    buckets = 1 << max(0, math.ceil(math.log2(max(rows, 1) / size)))
    return _stored(df, keys, path, buckets, F.lit(True) if live is None else live, {})


def change_version(
    old: Version, schema: T.StructType, delta: DataFrame, keys: Sequence[str], path: str,
    merge: Callable[[DataFrame, list[str]], DataFrame], live: Column | None = None, bucket_rows: int | None = None,
) -> Version:
    """A version with ``delta`` merged in; buckets that it does not meet are taken over as they are.

    ``merge`` gets the old rows of the buckets that are met together with the delta, and the column to add to the keys of its
    windows or groups: rows are dealt out by bucket once, and neither the merge nor the write shuffles them again.  ``delta`` is
    read twice and should be stored; it needs the columns of ``schema``.
    """
    spark = delta.sparkSession
    size, alive = bucket_rows or BUCKET_ROWS, F.lit(True) if live is None else live
    if old.rows > 2 * size * old.buckets:
        every = read_version(spark, old, schema).unionByName(delta, allowMissingColumns=True)
        buckets = 1 << math.ceil(math.log2(old.rows / size))
        placed = every.withColumn(BUCKET, bucket_of(keys, buckets)).repartition(BUCKET)
        return _stored(merge(placed, [BUCKET]), keys, path, buckets, alive, {})
    placed = delta.withColumn(BUCKET, bucket_of(keys, old.buckets))
    met = [r[BUCKET] for r in placed.select(BUCKET).distinct().collect()]  # at most one row per bucket
    known = read_version(spark, old, schema, met).withColumn(BUCKET, bucket_of(keys, old.buckets))
    merged = merge(known.unionByName(placed, allowMissingColumns=True).repartition(BUCKET), [BUCKET])
    return _stored(merged, keys, path, old.buckets, alive, {b: p for b, p in old.parts.items() if b not in set(met)})
