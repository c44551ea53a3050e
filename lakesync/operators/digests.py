"""Changed rows by two levels of digests.

Rows are dealt into buckets by a hash of their key, and every bucket has a digest that does not depend on order.  Two tables
are compared bucket by bucket first; only the rows of buckets that differ are compared one by one.  A snapshot keeps a table in
such buckets with their digests, so that a later comparison opens only the files of buckets that differ.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from lakesync.functions.values import hash_bits, row_hash
from lakesync.operators.sync import compare_signatures
from lakesync.sources import buckets

DIGEST = ("rows", "xor_bits", "sum_bits")


def bucket_digests(df: DataFrame, columns: Sequence[str], bucket: Column) -> DataFrame:
    """(bucket, rows, xor_bits, sum_bits): one row per bucket, combined before the shuffle."""
    bits = df.select(bucket.alias("bucket"), hash_bits(row_hash(df.schema, columns)).alias("bits"))
    return bits.groupBy("bucket").agg(
        F.count("*").alias("rows"), F.bit_xor("bits").alias("xor_bits"), F.sum(F.col("bits").cast("decimal(20,0)")).cast("string").alias("sum_bits"))


def differing_buckets(left: DataFrame, right: DataFrame) -> list[int]:
    """Numbers of the buckets whose digests differ or that one side lacks; at most one per bucket reaches the driver."""
    mine, other = left.select("bucket", F.struct(*DIGEST).alias("mine")), right.select("bucket", F.struct(*DIGEST).alias("other"))
    joined = mine.join(other, "bucket", "full").where(~F.col("mine").eqNullSafe(F.col("other")))
    return sorted(r.bucket for r in joined.select("bucket").collect())


def changed_rows(source: DataFrame, destination: DataFrame, keys: Sequence[str], columns: Sequence[str], n_buckets: int = 4096) -> DataFrame:
    """Keys that are new, changed or deleted, with both signatures; rows of equal buckets are neither shuffled nor compared."""
    place = buckets.bucket_of(keys, n_buckets)
    met = differing_buckets(bucket_digests(source, columns, place), bucket_digests(destination, columns, place))
    sides = (df.where(place.isin(met)) for df in (source, destination))
    return compare_signatures(*sides, keys, columns).where("row_state <> 'unchanged'")


@dataclass(frozen=True)
class Snapshot:
    """A table as it was, in buckets of its keys with their digests."""

    version: buckets.Version
    schema: T.StructType
    keys: tuple[str, ...]
    columns: tuple[str, ...]

    @property
    def digests(self) -> str:
        return f"{self.version.path}/digests"


def take_snapshot(df: DataFrame, keys: Sequence[str], columns: Sequence[str], path: str, bucket_rows: int | None = None) -> Snapshot:
    """Keep ``df`` for later comparisons; its digests are taken from the written files."""
    version = buckets.write_version(df, keys, path, df.count(), bucket_rows=bucket_rows)
    snapshot = Snapshot(version, df.schema, tuple(keys), tuple(columns))
    stored = buckets.read_version(df.sparkSession, version, df.schema)
    bucket_digests(stored, columns, buckets.bucket_of(keys, version.buckets)).write.parquet(snapshot.digests)
    return snapshot


def changes_since(snapshot: Snapshot, source: DataFrame) -> DataFrame:
    """``changed_rows`` of ``source`` against a snapshot, of which only buckets that differ are read."""
    place = buckets.bucket_of(snapshot.keys, snapshot.version.buckets)
    kept = source.sparkSession.read.parquet(snapshot.digests)
    met = differing_buckets(bucket_digests(source, snapshot.columns, place), kept)
    was = buckets.read_version(source.sparkSession, snapshot.version, snapshot.schema, met)
    return compare_signatures(source.where(place.isin(met)), was, snapshot.keys, snapshot.columns).where("row_state <> 'unchanged'")
