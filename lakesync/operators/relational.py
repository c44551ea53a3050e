"""Joins that have no single built-in operator."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, functions as F

from lakesync.workspace import fresh_dir
from lakesync.operators.ordered import with_last, with_running_total


def asof_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_order: str, right_order: str,
    take: Sequence[str], tie: str, right_tie: str, hot_rows: int | None = None, slices: int | None = None,
) -> DataFrame:
    """Each left row with the latest right row at or before it (nulls when there is none).

    Both sides are stacked and sorted once per key, so the cost is one shuffle
    of both inputs; hot keys are cut (see ``ordered``).  ``tie`` columns make
    the order unique within each side; on equal order the right row comes first.
    """
    marked_left = left.select(
        *keys, F.col(left_order).alias("__at"), F.lit(1).alias("__side"),
        F.col(tie).cast("bigint").alias("__tie"), F.struct(*left.columns).alias("__row"),
        F.lit(None).cast(right.select(F.struct(*take)).schema[0].dataType).alias("__take"),
    )
    marked_right = right.select(
        *keys, F.col(right_order).alias("__at"), F.lit(0).alias("__side"),
        F.col(right_tie).cast("bigint").alias("__tie"),
        F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("__row"),
        F.struct(*take).alias("__take"),
    )
    stacked = marked_left.unionByName(marked_right)
    filled = with_last(
        stacked, keys, ["__at", "__side", "__tie"], {"__found": F.col("__take")}, hot_rows, slices
    )
    return filled.where(F.col("__side") == 1).select(
        "__row.*", *(F.col("__found").getField(name).alias(name) for name in take)
    )


def range_counts(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str) -> DataFrame:
    """Number of points with ``low <= at < high`` for each range, in ``points_in``.

    The count is the difference of two running counts, those of the points below either end: points and ends are sorted
    together once, whatever the widths of the ranges and however many points they share.
    """
    ends = ranges.select(F.explode(F.array(low, high)).alias("__x")).where(F.col("__x").isNotNull()).distinct()
    marks = points.where(F.col(at).isNotNull()).groupBy(F.col(at).alias("__x")).agg(F.count("*").alias("__n"))
    # At the same place an end comes before the points there.
    both = ends.select("__x", F.lit(0).alias("__side"), F.lit(0).cast("bigint").alias("__n")).unionByName(
        marks.select("__x", F.lit(1).alias("__side"), "__n")
    ).withColumn("__all", F.lit(0))
    counted = with_running_total(both, ["__all"], ["__x", "__side"], {"__below": F.col("__n")}, all_hot=True)
    # Written once: both ends of a range are looked up in it.
    path = fresh_dir(points.sparkSession, "range-counts")
    counted.where(F.col("__side") == 0).select("__x", "__below").write.parquet(path)
    below = points.sparkSession.read.parquet(path)
    lower = below.select(F.col("__x").alias("__l"), F.col("__below").alias("__b_low"))
    upper = below.select(F.col("__x").alias("__h"), F.col("__below").alias("__b_high"))
    joined = ranges.join(lower, F.col(low) == F.col("__l"), "left").join(upper, F.col(high) == F.col("__h"), "left")
    inside = F.greatest(F.coalesce(F.col("__b_high") - F.col("__b_low"), F.lit(0)), F.lit(0))
    return joined.withColumn("points_in", inside).drop("__l", "__b_low", "__h", "__b_high")


def except_all(left: DataFrame, right: DataFrame, copies: int = 10_000) -> DataFrame:
    """Rows of the left side, each as often as it stands there more than on the right.

    Both sides are counted first.  What is left of a value is dealt out in parts of ``copies`` before its copies are
    written, so no task writes all of a value that stands there often.
    """
    columns = left.columns
    mine = left.groupBy(*columns).agg(F.count("*").alias("__mine"))
    theirs = right.toDF(*columns).groupBy(*columns).agg(F.count("*").alias("__theirs"))
    named = theirs.withColumnsRenamed({c: f"__r_{c}" for c in columns})
    on = reduce(and_, (F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in columns))
    rest = mine.join(named, on, "left").withColumn("__rest", F.col("__mine") - F.coalesce("__theirs", F.lit(0)))
    parts = rest.where(F.col("__rest") > 0).withColumn(
        "__part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("__rest") - 1) / copies)))
    )
    dealt = parts.select(*columns, F.least(F.lit(copies), F.col("__rest") - F.col("__part") * copies).cast("int").alias("__n"))
    spread = dealt.repartition(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return spread.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n")))).select(*columns)
