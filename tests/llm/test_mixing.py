import random
from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from lakesync.llm import mixing
from lakesync.llm.common import hash_key, materialise, running_totals
from hard_rows import hard, nothing  # noqa: F401


def filled(sizes, weights=(1, 2, 3), times=3):
    """Targets by pouring: share what is left by weight, hold who is above the limit, again until none is."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    held, total = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in held]
        left, of = total - sum(held.values()), sum(weight[s] for s in free)
        above = [s for s in free if Fraction(left * weight[s], of) > times * sizes[s]]
        if not above:
            return {s: float(Fraction(left * weight[s], of)) for s in free} | {s: float(v) for s, v in held.items()}
        held |= {s: times * sizes[s] for s in above}


def test_targets_equal_pouring(spark):
    random.seed(3)
    for _ in range(4):
        sizes = {s: random.choice([0, 1, 5, 40, 1000, 9000]) for s in ["a", "b", "ä", "", None, "Z"][: random.randrange(1, 7)]}
        rows = spark.createDataFrame([(s is None, s or "", n) for s, n in sizes.items()], "__no_source boolean, __source string, source_size long")
        got = {None if r["__no_source"] else r["__source"]: r["target"] for r in mixing.source_targets(rows).collect()}
        assert got == {s: pytest.approx(v) for s, v in filled(sizes).items()}


def test_mix_is_near_its_targets_and_repeatable(spark):
    rows = [(k, f"s{0 if k < 700 else k % 5}", 1 + k * 37 % 90) for k in range(2000)]
    sized = spark.createDataFrame(rows, "doc_id long, source string, size long").withColumn("key", hash_key(F.col("doc_id")))
    one, two = (sorted(tuple(r) for r in mixing.mix(sized.repartition(n)).select("doc_id", "source", "size", "source_size", "target", "taken").collect()) for n in (2, 5))
    assert one == two and len(one) == 2000
    taken, target, size = defaultdict(int), {}, defaultdict(int)
    for _, s, n, all_, t, k in one:
        assert k % n == 0 and 0 <= k <= 3 * n
        taken[s] += k
        size[s] += n
        target[s] = t
    assert target == {s: pytest.approx(v) for s, v in filled(size).items()}
    assert all(abs(taken[s] - target[s]) <= 90 for s in target)


def test_running_totals_of_a_hot_group(spark):
    rows = spark.createDataFrame([("hot" if k % 3 else "cold", k, k % 11) for k in range(3000)], "g string, doc_id long, size long").withColumn(
        "key", hash_key(F.col("doc_id")))
    got = running_totals(rows, ["g"], "key", "size", ["doc_id"]).collect()
    for g in ("hot", "cold"):
        before, ordered = 0, sorted((r for r in got if r["g"] == g), key=lambda r: (r["key"], r["doc_id"]))
        for slot, r in enumerate(ordered):
            assert (r["before"], r["slot"]) == (before, slot)
            before += r["size"]


def test_hard_rows(hard, nothing):
    rows = mixing.mix(materialise(mixing.sized_documents(hard), "t")).collect()
    assert len(rows) == hard.count() and all(r["taken"] == 0 for r in rows if r["size"] == 0)
    assert {r["size"] for r in rows if r["doc_id"] in (3, 4, 5)} == {0}
    mixed = mixing.mixed_documents(hard)
    assert mixed.columns == hard.columns
    assert sum(len((r["text"] or "").split()) for r in mixed.collect()) >= sum(r["taken"] for r in rows)
    assert mixing.mix(mixing.sized_documents(nothing)).count() == 0 and mixing.mixed_documents(nothing).count() == 0


def test_equal_rows_are_taken_one_by_one(spark):
    """Fifty equal rows at a target between whole numbers of copies, and a column that the stage might use itself."""
    rows = [(1, "w " * 10, "a", "x")] * 50 + [(k, "v " * 10, "b", "y") for k in range(100, 130)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, __row string")
    mixed = mixing.mixed_documents(docs)
    target = {r["source"]: r["target"] for r in mixing.mix(mixing.sized_documents(docs)).select("source", "target").distinct().collect()}
    assert mixed.columns == docs.columns and {r["__row"] for r in mixed.collect()} == {"x", "y"}
    for source, n in mixed.groupBy("source").count().collect():
        assert abs(10 * n - target[source]) <= 5


def test_rows_without_id_are_spread(spark):
    docs = spark.createDataFrame([(None, f"text {k} " * (k % 7 + 1), "a") for k in range(3000)], "doc_id long, text string, source string")
    keys = mixing.sized_documents(docs).groupBy(F.substring("key", 1, 2)).count()
    assert keys.count() > 200 and keys.agg(F.max("count")).first()[0] < 40
