"""Ordered per-key work that survives hot keys.

A window puts all rows of one key into one task.  Where a key can hold a large
share of the table that does not scale, so the functions here first look for
hot keys (one pre-aggregated count, kept as a table: however many there are,
none reaches the driver).  Without any, they plan an ordinary window.  With
some, the rows of the hot keys are range-sorted into slices of equal size,
each slice is worked on by itself, and one small summary row per slice carries
what later slices need.  Results are the same either way.

``order`` names columns that together are unique within a key.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from lakesync.workspace import fresh_dir

SLICE = "__slice"
COLD = -1  # slice number of rows whose key is not hot
# Keys with more rows than this are split: about what a task sorts without trouble.
DEFAULT_HOT_ROWS = 5_000_000


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int | None = None) -> DataFrame | None:
    """The hot keys, one row each, counted once and stored; None when there are none."""
    limit = DEFAULT_HOT_ROWS if hot_rows is None else hot_rows
    counted = df.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > limit).select(*keys)
    path = fresh_dir(df.sparkSession, "hot_keys")
    counted.write.parquet(path)
    stored = df.sparkSession.read.schema(counted.schema).parquet(path)
    return None if stored.isEmpty() else stored


def split_by(df: DataFrame, keys: Sequence[str], hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the hot keys and the other rows (null keys match each other)."""
    named = hot.withColumnsRenamed({k: f"__h_{k}" for k in keys})
    on = reduce(and_, (F.col(k).eqNullSafe(F.col(f"__h_{k}")) for k in keys))
    return df.join(named, on, "left_semi"), df.join(named, on, "left_anti")


def cut_hot_keys(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], hot_rows: int | None, slices: int | None,
    all_hot: bool = False,
) -> tuple[DataFrame, list[str]]:
    """Rows with their slice, and the columns to partition windows by.

    The slices of hot rows are ranges of key and order.  They are written once,
    so a lost task cannot move a row from one slice to another.  ``all_hot``:
    only rows of hot keys are given, and need not be counted again.
    """
    hot = None if all_hot else hot_keys(df, keys, hot_rows)
    if hot is None and not all_hot:
        return df, list(keys)
    spark = df.sparkSession
    n = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = fresh_dir(spark, "slices")
    warm, cold = (df, None) if all_hot else split_by(df, keys, hot)
    sliced = warm.repartitionByRange(n, *keys, *order).withColumn(SLICE, F.spark_partition_id())
    sliced.write.parquet(path)
    stored = spark.read.schema(sliced.schema).parquet(path)
    every = stored if cold is None else cold.withColumn(SLICE, F.lit(COLD)).unionByName(stored)
    return every, [*keys, SLICE]


def _with_summary(df: DataFrame, summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join of one summary row per hot key and slice; null keys match each other.

    Slices are ranges of key and order, so there are at most as many summary
    rows as slices and hot keys together; Spark broadcasts them by their size.
    """
    named = summary.withColumnsRenamed({k: f"__k_{k}" for k in [*keys, SLICE]})
    on = reduce(and_, (F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in [*keys, SLICE]))
    return df.join(named, on, "left").drop(*(f"__k_{k}" for k in [*keys, SLICE]))


def _earlier_slices(
    cut: DataFrame, keys: Sequence[str], aggregates: dict[str, Column], fold
) -> DataFrame:
    """Per hot key and slice: ``fold`` over the aggregates of all earlier slices."""
    per_slice = cut.where(F.col(SLICE) != COLD).groupBy(*keys, SLICE).agg(
        *(agg.alias(name) for name, agg in aggregates.items())
    )
    earlier = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    return per_slice.select(*keys, SLICE, *(fold(F.col(name)).over(earlier).alias(name) for name in aggregates))


def with_position(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "position",
    hot_rows: int | None = None, slices: int | None = None, all_hot: bool = False,
) -> DataFrame:
    """1-based position of each row in its key."""
    cut, by = cut_hot_keys(df, keys, order, hot_rows, slices, all_hot)
    local = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    numbered = cut.withColumn(out, local.cast("bigint"))
    if SLICE not in by:
        return numbered
    before = _earlier_slices(cut, keys, {"__before": F.count("*")}, F.sum)
    joined = _with_summary(numbered, before, keys)
    return joined.withColumn(out, F.col(out) + F.coalesce("__before", F.lit(0))).drop(SLICE, "__before")


def with_running_total(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], totals: dict[str, Column],
    hot_rows: int | None = None, slices: int | None = None, all_hot: bool = False,
) -> DataFrame:
    """Running sums by key up to and including the row."""
    cut, by = cut_hot_keys(df, keys, order, hot_rows, slices, all_hot)
    frame = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = cut.withColumns({name: F.sum(value).over(frame) for name, value in totals.items()})
    if SLICE not in by:
        return local
    before = _earlier_slices(cut, keys, {f"__b_{n}": F.sum(v) for n, v in totals.items()}, F.sum)
    joined = _with_summary(local, before, keys)
    full = {
        name: F.when(F.col(f"__b_{name}").isNull(), F.col(name))
        .otherwise(F.col(f"__b_{name}") + F.coalesce(F.col(name), F.lit(0)))
        for name in totals
    }
    return joined.withColumns(full).drop(SLICE, *(f"__b_{n}" for n in totals))


def with_last(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, Column],
    hot_rows: int | None = None, slices: int | None = None,
) -> DataFrame:
    """Last non-null value by key up to and including the row."""
    cut, by = cut_hot_keys(df, keys, order, hot_rows, slices)
    cut = cut.withColumns({f"__v_{name}": value for name, value in values.items()})
    frame = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = cut.withColumns(
        {name: F.last(F.col(f"__v_{name}"), ignorenulls=True).over(frame) for name in values}
    ).drop(*(f"__v_{n}" for n in values))
    if SLICE not in by:
        return local

    def newest(name: str) -> Column:
        value = F.col(f"__v_{name}")
        return F.max_by(value, F.when(value.isNotNull(), F.struct(*order)))

    carried = _earlier_slices(
        cut, keys, {f"__c_{n}": newest(n) for n in values}, lambda c: F.last(c, ignorenulls=True)
    )
    joined = _with_summary(local, carried, keys)
    filled = {n: F.coalesce(F.col(n), F.col(f"__c_{n}")) for n in values}
    return joined.withColumns(filled).drop(SLICE, *(f"__c_{n}" for n in values))


def with_frame(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], before: int, after: int,
    outputs: dict[str, object], hot_rows: int | None = None, block_rows: int | None = None,
    slices: int | None = None,
) -> DataFrame:
    """Values over nearby rows (lag, lead, moving frames).

    ``outputs`` maps names to functions that take an ordered window and return
    a Column reaching at most ``before`` rows back and ``after`` ahead.  Hot
    keys are cut into blocks of consecutive positions; each block also gets
    the neighbouring rows it needs and drops them again at the end.
    """
    hot = hot_keys(df, keys, hot_rows)
    if hot is None:
        window = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumns({name: make(window) for name, make in outputs.items()})
    block_rows = max(block_rows or hot_rows or DEFAULT_HOT_ROWS, before + after, 1)
    # Cold keys fit into one block each, so they only need a position where hot ones do.
    warm, cold = split_by(df, keys, hot)
    placed = with_position(warm, keys, order, "__pos", hot_rows, slices, all_hot=True)
    zero = F.col("__pos") - 1
    block, offset = F.floor(zero / block_rows), zero % block_rows
    none = F.lit(None).cast("bigint")
    blocks = F.array_compact(
        F.array(
            block, F.when(offset >= block_rows - before, block + 1) if before else none,
            F.when((offset < after) & (block > 0), block - 1) if after else none,
        )
    )
    copied = placed.withColumn("__home", block).withColumn("__block", F.explode(blocks))
    cold = cold.withColumns({"__home": F.lit(0).cast("bigint"), "__block": F.lit(0).cast("bigint")})
    window = Window.partitionBy(*keys, "__block").orderBy(*order)
    every = cold.unionByName(copied.drop("__pos"))
    done = every.withColumns({name: make(window) for name, make in outputs.items()})
    return done.where(F.col("__home") == F.col("__block")).drop("__home", "__block")


def row_index(df: DataFrame, order: Sequence[str | Column], out: str = "row_index") -> DataFrame:
    """0-based index over the whole table in the given order, without a one-task window.

    The rows are range-sorted and written once, so that a lost task cannot move
    a row to another range; the count of each range then gives its offset.
    ``order`` should be unique: rows that compare equal cannot be split.
    """
    spark = df.sparkSession
    path = fresh_dir(spark, "row_index")
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(
        "__id", F.monotonically_increasing_id()
    )
    placed.write.parquet(path)
    stored = spark.read.schema(placed.schema).parquet(path)
    # The id holds the range number above 33 bits of position.
    part, at = F.shiftright("__id", 33), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = stored.groupBy(part.alias("__part")).agg((F.max(at) + 1).alias("__n"))
    # One row per range: this window, and what is broadcast, is as small as the list of ranges.
    offsets = sizes.select(
        "__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__offset")
    )
    return (
        stored.withColumn("__part", part).join(F.broadcast(offsets), "__part")
        .withColumn(out, (F.col("__offset") + at).cast("bigint"))
        .drop("__part", "__id", "__offset")
    )
