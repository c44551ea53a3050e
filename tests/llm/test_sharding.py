import itertools
import random
from collections import Counter

from pyspark.sql import functions as F

from lakesync.llm import sharding
from lakesync.llm.common import materialise
from lakesync.workspace import fresh_dir
from hard_rows import hard, nothing  # noqa: F401


def cost_by_search(supply, demand, cost):
    """The cheapest transport of a few units by trying all orders of the demands."""
    units = [i for i, n in enumerate(supply) for _ in range(n)]
    places = [j for j, n in enumerate(demand) for _ in range(n)]
    return min(sum(cost(i, j) for i, j in zip(units, order)) for order in set(itertools.permutations(places)))


def test_flow_is_cheapest():
    random.seed(2)
    for _ in range(25):
        supply = [random.randrange(3) for _ in range(3)]
        demand = sharding.capacities(sum(supply), random.randrange(1, 4))
        prices = {(i, j): random.randrange(5) for i in range(3) for j in range(len(demand))}
        flow = sharding.least_cost_flow(supply, demand, lambda i, j: prices[i, j])
        assert all(sum(v for (a, _), v in flow.items() if a == i) == n for i, n in enumerate(supply))
        assert all(sum(v for (_, b), v in flow.items() if b == j) == n for j, n in enumerate(demand))
        assert sum(prices[e] * v for e, v in flow.items()) == cost_by_search(supply, demand, lambda i, j: prices[i, j])


def test_bytes_that_move_are_the_fewest():
    random.seed(4)
    for old, new in ((32, 40), (40, 32), (5, 5), (1, 7)):
        supply = [random.randrange(10**6) for _ in range(old)]
        room = sharding.capacities(sum(supply), new)
        flow = sharding.least_cost_flow(supply, room, lambda i, j: int(i != j))
        assert sum(v for (i, j), v in flow.items() if i == j) == sum(min(a, b) for a, b in zip(supply, room))
        assert len(flow) <= old + new


def resharded(spark, rows, old, new):
    from pyspark.sql import functions as F

    from lakesync.llm.common import hash_key

    frame = spark.createDataFrame(rows, "doc_id long, old int, size long").withColumn("key", hash_key(F.col("doc_id")))
    return sharding.reshard(frame, old, new)


def test_shards_are_even_and_slots_gapless(spark):
    rows = [(k, 0 if k % 2 else k % 5, 20 + k * 31 % 200) for k in range(4000)]
    got = resharded(spark, rows, 5, 8).collect()
    sizes, slots = Counter(), {}
    for r in got:
        sizes[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert len(got) == 4000 and set(sizes) == set(range(8))
    assert max(sizes.values()) - min(sizes.values()) <= 4 * 220
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_only_affected_shards_are_written(spark):
    rows = [(k, k % 3, 100) for k in range(300)] + [(1000 + k, 1, 100) for k in range(60)]
    folders = {}
    for i in range(3):
        folders[i] = fresh_dir(spark, "shards")
        spark.createDataFrame([(d, f"text {d}", "clash") for d, o, _ in rows if o == i], "doc_id long, text string, shard string").write.parquet(folders[i])
    placed = resharded(spark, rows, 3, 3)
    after = sharding.rewrite_affected(spark, folders, placed)
    assert after != folders and {r["doc_id"] for f in after.values() for r in spark.read.parquet(f).collect()} == {d for d, _, _ in rows}
    for r in placed.filter("shard = 2").collect():
        assert spark.read.parquet(after[2]).filter(f"doc_id = {r['doc_id']}").count() == 1
        break
    still = placed.withColumn("shard", placed["old"])
    assert sharding.rewrite_affected(spark, folders, still) == folders


def test_null_and_repeated_ids_stay_whole(spark):
    rows = [(None if k % 5 == 0 else k // 3, 0 if k < 200 else k % 3, 100) for k in range(300)]
    folders = {}
    for i in range(3):
        folders[i] = fresh_dir(spark, "shards")
        spark.createDataFrame([(d, f"text {k}") for k, (d, o, _) in enumerate(rows) if o == i], "doc_id long, text string").write.parquet(folders[i])
    placed = materialise(resharded(spark, rows, 3, 3), "t")
    after = sharding.rewrite_affected(spark, folders, placed)
    written = {j: spark.read.parquet(f).collect() for j, f in after.items()}
    assert sorted(r["text"] for found in written.values() for r in found) == sorted(f"text {k}" for k in range(300))
    wanted = Counter((r["shard"], r["doc_id"]) for r in placed.collect())
    assert Counter((j, r["doc_id"]) for j, found in written.items() for r in found) == wanted


def test_the_query_rewrites_every_row(spark, hard, monkeypatch):
    after, rewrite = [], sharding.rewrite_blocks
    monkeypatch.setattr(sharding, "rewrite_blocks", lambda laid, placed: after.append((laid, *rewrite(laid, placed))))
    path = fresh_dir(spark, "sf")
    more = hard.unionByName(hard).withColumn("source", F.coalesce("source", F.lit("b")))
    more.write.parquet(f"{path}/documents.parquet")
    first, again = (sorted(tuple(r) for r in sharding.op10_reshard(spark, path).drop("grown_shard").na.fill(-1).collect()) for _ in (0, 1))
    assert first == again
    laid, target, stay = after[0]
    placed = Counter((r[4], r[0], r[1]) for r in first)
    rows = [(r["__shard"], r) for r in spark.read.parquet(target).collect()] + [(r["__at"], r) for r in laid.collect() if r["__at"] in stay]
    assert Counter((j, -1 if r["doc_id"] is None else r["doc_id"], len((r["text"] or "").encode()) + 16) for j, r in rows) == placed
    assert Counter(r["text"] for _, r in rows) == Counter(r["text"] for r in more.collect())
    assert set(spark.read.parquet(target).columns) == {*hard.columns, "__shard"}


def test_hard_rows(spark, hard, nothing):
    path = fresh_dir(spark, "sf")
    hard.write.parquet(f"{path}/documents.parquet")
    rows = sharding.op10_reshard(spark, path).collect()
    assert len(rows) == hard.count() and {r["size"] for r in rows if r["doc_id"] in (3, 4)} == {16}
    assert all(0 <= r["shard"] < 40 and r["grown_shard"] is None and r["law"] == "bytes" for r in rows)
    empty = fresh_dir(spark, "sf")
    nothing.write.parquet(f"{empty}/documents.parquet")
    assert sharding.op10_reshard(spark, empty).count() == 0
