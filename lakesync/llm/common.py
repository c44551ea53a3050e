"""Pieces that several corpus operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakesync.workspace import fresh_dir

#: A word is a run of characters other than these six.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
OTHER_SPACE = r"[\t\n\x0B\f\r]"
#: Hex digits of a hash key that name its bucket: 4096 buckets in each group.
BUCKET_DIGITS = 3
#: Text that a task works on at once.
BATCH_BYTES = 4 << 20


def materialise(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, which also cuts its lineage."""
    path = fresh_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def split_words(text: Column) -> Column:
    """The words of a text, in order; an empty array without words."""
    return F.array_remove(F.split(F.regexp_replace(text, OTHER_SPACE, " "), " "), "")


def word_count(text: Column) -> Column:
    return F.size(split_words(text)).cast("long")


def fold_of(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; rows without an id are in fold 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts, F.lit(0).cast("long"))


def hash_key(*columns: Column) -> Column:
    """A random-looking order key (hex text) that only depends on the given values."""
    return F.md5(F.concat_ws("\x1f", *(F.coalesce(c.cast("string"), F.lit("\x00")) for c in columns)))


def running_totals(df: DataFrame, group: list[str], key: str, size: str, ties: list[str]) -> DataFrame:
    """Add ``before`` and ``slot``: the sum of ``size`` and the number of rows that precede a row within its group.

    Rows of a group are ordered by the hash key, then by ``ties``.  Hash keys are uniform, so their first digits cut
    every group, however hot, into equal ranges.  Range totals (at most 4096 rows a group) are summed up in range order
    and added to the running totals inside each range.  ``group`` columns must not be null.
    """
    bucketed = df.withColumn("__bucket", F.substring(key, 1, BUCKET_DIGITS))
    in_group = Window.partitionBy(*group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        bucketed.groupBy(*group, "__bucket").agg(F.sum(size).alias("__sum"), F.count(F.lit(1)).alias("__rows"))
        .withColumn("__sum_before", F.coalesce(F.sum("__sum").over(in_group), F.lit(0)))
        .withColumn("__rows_before", F.coalesce(F.sum("__rows").over(in_group), F.lit(0)))
        .drop("__sum", "__rows")
    )
    in_bucket = Window.partitionBy(*group, "__bucket").orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, 0)
    return (
        bucketed.join(offsets, [*group, "__bucket"])
        .withColumn("before", F.col("__sum_before") + F.sum(size).over(in_bucket) - F.col(size))
        .withColumn("slot", F.col("__rows_before") + F.row_number().over(in_bucket) - 1)
        .drop("__bucket", "__sum_before", "__rows_before")
    )


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        out.append(name)
    return out


def cut_by_bytes(batch: pa.RecordBatch, column: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``most`` bytes of text, or of one longer text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    begin, held = 0, 0
    for at, size in enumerate(sizes.tolist()):
        if at > begin and held + size > most:
            yield batch.slice(begin, at - begin)
            begin, held = at, 0
        held += size
    if begin < len(batch):
        yield batch.slice(begin)


def giving_back(batches: Iterator) -> Iterator:
    """The batches; after the last, memory that Arrow keeps in reserve goes back, as Python workers outlive their tasks."""
    yield from batches
    pa.default_memory_pool().release_unused()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
