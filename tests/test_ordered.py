"""Hot keys are cut without changing any result."""

import pytest
from pyspark.sql import Window, functions as F

from lakesync.operators.ordered import hot_keys, row_index, with_frame, with_last, with_position, with_running_total
from lakesync.operators.relational import asof_join, except_all, range_counts
from lakesync.operators.sync import version_history

KEYS, ORDER = ["k"], ["at", "n"]
SPLIT = {"hot_rows": 40, "slices": 7}


@pytest.fixture(scope="module")
def frame(spark):
    """A third of the rows share one key, others share a null key; order values repeat."""
    n = F.col("id")
    key = F.when(n % 3 == 0, F.lit(1)).when(n % 7 == 0, F.lit(None)).otherwise((n % 20 + 2).cast("int"))
    return spark.range(900).select(
        n.alias("n"), key.alias("k"), ((n * 37) % 101).alias("at"), (n % 11).alias("v"),
        F.when(n % 4 == 0, n).alias("sparse"),
    ).cache()


def same(left, right):
    assert sorted(map(tuple, left.collect()), key=repr) == sorted(map(tuple, right.select(left.columns).collect()), key=repr)


def window():
    return Window.partitionBy(*KEYS).orderBy(*ORDER)


def test_position(frame):
    same(with_position(frame, KEYS, ORDER, **SPLIT), frame.withColumn("position", F.row_number().over(window()).cast("bigint")))


def test_running_total(frame):
    total = F.sum("sparse").over(window().rowsBetween(Window.unboundedPreceding, 0))
    same(with_running_total(frame, KEYS, ORDER, {"t": F.col("sparse")}, **SPLIT), frame.withColumn("t", total))


def test_last_value(frame):
    last = F.last("sparse", ignorenulls=True).over(window().rowsBetween(Window.unboundedPreceding, 0))
    same(with_last(frame, KEYS, ORDER, {"l": F.col("sparse")}, **SPLIT), frame.withColumn("l", last))


def test_frames(frame):
    outputs = {
        "lag": lambda w: F.lag("n", 2).over(w), "lead": lambda w: F.lead("n").over(w),
        "moving": lambda w: F.sum("v").over(w.rowsBetween(-2, 1)),
    }
    cut = with_frame(frame, KEYS, ORDER, 2, 1, outputs, block_rows=9, **SPLIT)
    same(cut, frame.withColumns({n: make(window()) for n, make in outputs.items()}))


def test_two_keys(frame):
    two = frame.withColumn("j", F.col("n") % 2)
    want = two.withColumn("position", F.row_number().over(Window.partitionBy("k", "j").orderBy(*ORDER)).cast("bigint"))
    same(with_position(two, ["k", "j"], ORDER, hot_rows=20, slices=5), want)


def test_history(frame):
    cut = version_history(frame, KEYS, ORDER, **SPLIT)
    same(cut, version_history(frame, KEYS, ORDER))
    assert cut.where("is_current").count() == frame.select("k").distinct().count()


def test_row_index(frame):
    got = [tuple(r) for r in row_index(frame, ["at", "n"]).select("row_index", "at", "n").orderBy("row_index").collect()]
    want = sorted((r.at, r.n) for r in frame.collect())
    assert got == [(i, at, n) for i, (at, n) in enumerate(want)]


def test_asof_join(spark, frame):
    left = frame.where("n % 2 = 0").select("k", "at", "n")
    right = frame.where("n % 5 = 0").select("k", "at", F.col("n").alias("m"), F.col("v").alias("w"))
    cut = asof_join(left, right, KEYS, "at", "at", ["m", "w"], "n", "m", **SPLIT)
    found = {}
    for r in right.collect():
        found.setdefault(r.k, []).append((r.at, r.m, r.w))
    want = []
    for row in left.collect():
        before = [x for x in found.get(row.k, []) if x[0] <= row.at]
        best = max(before) if before else (None, None, None)
        want.append((row.k, row["at"], row.n, best[1], best[2]))
    assert sorted(map(tuple, cut.select("k", "at", "n", "m", "w").collect()), key=repr) == sorted(want, key=repr)


def test_range_counts(spark):
    points = spark.createDataFrame([(float(x) / 3,) for x in range(60)] * 2 + [(None,)], "p double")
    ranges = spark.createDataFrame([(0.5, 2.5), (2.5, 9.0), (4.0, 4.0), (17.2, 30.0), (-3.0, 0.1), (9.0, 1.0), (None, 5.0), (1.0, 2.0), (1.0, 2.0)],
                                   "low double, high double")
    got = sorted(map(tuple, range_counts(points, ranges, "p", "low", "high").collect()), key=repr)
    inside = lambda r: sum(r.low is not None and p.p is not None and r.low <= p.p < r.high for p in points.collect())
    assert got == sorted(((r.low, r.high, inside(r)) for r in ranges.collect()), key=repr)


def test_except_all(spark):
    left = spark.createDataFrame([(1, "a")] * 25 + [(2, None)] * 3 + [(None, "x")] * 2, "k int, t string")
    right = spark.createDataFrame([(1, "a")] * 4 + [(2, None)] * 5 + [(9, "z")], "a int, b string")
    got = sorted((tuple(r) for r in except_all(left, right, copies=7).collect()), key=repr)
    assert got == sorted((tuple(r) for r in left.exceptAll(right).collect()), key=repr) and len(got) == 23


def test_any_number_of_hot_keys(spark):
    frame = spark.range(12_000).selectExpr("id % 3000 AS k", "id", "1 AS one")
    cut = with_position(frame, ["k"], ["id"], "n", hot_rows=2, slices=5)
    assert cut.count() == 12_000 and cut.where("n <> floor(id / 3000) + 1").count() == 0
    assert hot_keys(frame, ["k"], 2).count() == 3000 and hot_keys(frame, ["k"], 4) is None
