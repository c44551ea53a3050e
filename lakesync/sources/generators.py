"""Deterministic generated rows.

Each generator takes an index table with a column ``i``; ``index(spark, n)``
gives 1..n.  Rows are computed in parallel from the index alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

PRODUCTS = 10


def index(spark: SparkSession, count: int, start: int = 1) -> DataFrame:
    if count < 1:
        raise ValueError("count starts at one")
    return spark.range(start, start + count).withColumnRenamed("id", "i")


def _updated_at(i: Column) -> Column:
    """Day 1..28 of one month, from the index and not from the seed."""
    return F.format_string("2026-01-%02dT00:00:00Z", (i - 1) % 28 + 1)


def users(indexed: DataFrame, seed: int = 0) -> DataFrame:
    i = F.col("i")
    n = i + max(seed, 0)
    return indexed.select(
        F.format_string("user_%03d", n).alias("id"), F.format_string("User %03d", n).alias("name"),
        F.format_string("user%03d@example.com", n).alias("email"), _updated_at(i).alias("updated_at"),
    )


def purchases(indexed: DataFrame, seed: int = 0) -> DataFrame:
    i = F.col("i")
    n, product = i + max(seed, 0), i % PRODUCTS + 1
    return indexed.select(
        F.format_string("purchase_%03d", n).alias("id"), F.format_string("user_%03d", n).alias("user_id"),
        F.format_string("product_%03d", product).alias("product_id"),
        (product.cast("double") * F.lit(9.99)).alias("amount"), _updated_at(i).alias("updated_at"),
    )


def products(spark: SparkSession) -> DataFrame:
    i = F.col("i")
    return index(spark, PRODUCTS).select(
        F.format_string("product_%03d", i).alias("id"), F.format_string("SKU-%03d", i).alias("sku"),
        F.format_string("Product %03d", i).alias("name"), (i.cast("double") * F.lit(4.25)).alias("price"),
    )


def sync_bench_rows(indexed: DataFrame) -> DataFrame:
    """Rows of the sync benchmark; the index starts at 0 and counts seconds."""
    i = F.col("i")
    at = F.timestamp_add("SECOND", i, F.to_timestamp_ntz(F.lit("2026-01-01 00:00:00")))
    return indexed.select(
        F.format_string("rec_%06d", i).alias("id"), F.format_string("Record %06d", i).alias("name"),
        F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("updated_at"),
    )
