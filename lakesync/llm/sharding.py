"""Minimum-cost-flow resharding: the cheapest block transfers from old shards to new capacities.

Old shard sizes and new capacities are a transport problem with a node per old and per new shard: bytes that stay cost
nothing, bytes that move cost their number.  It is solved exactly on the driver, where it has at most old x new edges
(the shard counts are parameters; documents never reach the driver).  Each old shard is then cut, in hash-random order
and by prefix sums of bytes, into the blocks the flow asks for: the block that stays and one for each shard that receives.
A document belongs to the block its middle byte falls into, so a block is off by half a document at most.

Defined results: a null text has 16 bytes, like an empty one, and crc 0; a null source is the old shard of the empty
name; repeated rows are neighbours and count separately; an empty table gives an empty table.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakesync.llm.common import hash_key, materialise, running_totals, text_or_empty
from lakesync.workspace import fresh_dir

#: Bytes that a row takes besides its text.
ROW_BYTES = 16
NEW_SHARDS = 40
OLD_SHARDS = 32


def capacities(total: int, shards: int) -> list[int]:
    """Equal shares of ``total``; the first ones get the remainder, one each."""
    share, more = divmod(total, shards)
    return [share + (j < more) for j in range(shards)]


def least_cost_flow(supply: list[int], demand: list[int], cost) -> dict[tuple[int, int], int]:
    """Flow {(i, j): amount} from supplies to demands (equal in sum) of the least total cost.

    Successive shortest paths: each round finds a cheapest path through the residual graph from a supply with something
    left to a demand with room, and sends what fits.  ``cost(i, j)`` is the price of a unit.
    """
    if sum(supply) != sum(demand):
        raise ValueError("supply and demand differ")
    flow: dict[tuple[int, int], int] = {}
    left, room = list(supply), list(demand)
    old, new = range(len(supply)), range(len(demand))
    while any(left):
        # Nodes: ("i", n) for supplies, ("j", n) for demands; the queue holds nodes whose distance fell.
        best = {("i", i): 0 for i in old if left[i]}
        came: dict[tuple[str, int], tuple[str, int]] = {}
        queue = deque(best)
        while queue:
            side, n = node = queue.popleft()
            steps = ([(("j", j), cost(n, j)) for j in new] if side == "i"
                     else [(("i", i), -cost(i, n)) for i in old if flow.get((i, n))])
            for other, price in steps:
                if best[node] + price < best.get(other, float("inf")):
                    best[other], came[other] = best[node] + price, node
                    queue.append(other)
        end = min((("j", j) for j in new if room[j]), key=lambda x: (best[x], x[1]))
        path, node = [], end
        while node in came:
            path.append((came[node], node))
            node = came[node]
        amount = min([left[node[1]], room[end[1]], *(flow[b[1], a[1]] for a, b in path if a[0] == "j")])
        for a, b in path:
            edge, sign = ((a[1], b[1]), 1) if a[0] == "i" else ((b[1], a[1]), -1)
            flow[edge] = flow.get(edge, 0) + sign * amount
        left[node[1]] -= amount
        room[end[1]] -= amount
    return {k: v for k, v in flow.items() if v}


def transfer_plan(spark: SparkSession, old_sizes: dict[int, int], old_shards: int, new_shards: int) -> DataFrame:
    """Blocks (old, new, from_byte, to_byte) of every old shard; the block that stays comes first."""
    supply = [old_sizes.get(i, 0) for i in range(old_shards)]
    flow = least_cost_flow(supply, capacities(sum(supply), new_shards), lambda i, j: int(i != j))
    blocks, at = [], [0] * old_shards
    for i, j in sorted(flow, key=lambda e: (e[0], e[0] != e[1], e[1])):
        blocks.append((i, j, at[i], at[i] + flow[i, j]))
        at[i] += flow[i, j]
    return spark.createDataFrame(blocks, "old int, new int, from_byte long, to_byte long")


def reshard(rows: DataFrame, old_shards: int, new_shards: int) -> DataFrame:
    """``rows``: doc_id, old, size, key.  Adds shard and slot, with the fewest bytes moved for shards of equal bytes."""
    rows = materialise(rows, "reshard-sizes")
    sizes = {r["old"]: r["bytes"] for r in rows.groupBy("old").agg(F.sum("size").alias("bytes")).collect()}
    plan = transfer_plan(rows.sparkSession, sizes, old_shards, new_shards).withColumnRenamed("old", "__old")
    middle = F.col("before") + F.floor(F.col("size") / 2)
    ties = [c for c in ("doc_id", "size", "__row") if c in rows.columns]
    placed = running_totals(rows, ["old"], "key", "size", ties).drop("slot")
    # At most old x new rows, a number fixed by the parameters.
    moved = placed.join(F.broadcast(plan), (F.col("old") == F.col("__old")) & (middle >= F.col("from_byte")) & (middle < F.col("to_byte")))
    moved = materialise(moved.withColumn("shard", F.col("new")).drop("__old", "new", "from_byte", "to_byte", "before"), "reshard-plan")
    return running_totals(moved, ["shard"], "key", "size", ties).drop("before")


def old_shard(source: str, shards: int = OLD_SHARDS):
    """The layout to start from: one shard per source, by hash, and so as uneven as the sources."""
    return (F.crc32(F.coalesce(F.col(source).cast("string"), F.lit("")).cast("binary")) % shards).cast("int")


def order_key() -> Column:
    """The place of a row within its old shard, by hash of id and text; rows equal in both follow by ``__row``."""
    return hash_key(F.col("doc_id"), F.md5(text_or_empty().cast("binary")))


def lay_out(docs: DataFrame) -> DataFrame:
    """The documents in their old shards (``__at``), with a number of its own (``__row``) for each row."""
    path = fresh_dir(docs.sparkSession, "old-shards")
    numbered = docs.withColumns({"__row": F.monotonically_increasing_id(), "__at": old_shard("source")})
    numbered.write.option("compression", "zstd").partitionBy("__at").parquet(path)
    return docs.sparkSession.read.schema(docs.select("*", F.lit(0).cast("long").alias("__row"), F.lit(0).alias("__at")).schema).parquet(path)


def op10_reshard(spark, sf_dir: str) -> DataFrame:
    laid = lay_out(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    text = text_or_empty()
    rows = laid.select(
        "__row", "doc_id", F.col("__at").alias("old"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), order_key().alias("key"))
    placed = materialise(reshard(rows, OLD_SHARDS, NEW_SHARDS), "reshard-slots")
    rewrite_blocks(laid, placed)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), F.col("old").alias("old_shard"))


def rewrite_blocks(laid: DataFrame, placed: DataFrame) -> tuple[str, set[int]]:
    """Write the shards that gain or lose rows; the folder they are in, and which old shards stay as they are.

    Every old shard was cut into blocks of neighbouring rows, so a row's shard follows from its place alone: the first place
    of each block (at most old x new rows) goes to all tasks, and the files of affected shards are read and written once,
    without a shuffle.  Another number of rows than before is an error; the old files stay valid until the caller switches over.
    """
    spark = laid.sparkSession
    place = F.struct("key", "__row")
    blocks = placed.groupBy("old", "shard").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).collect()
    affected = {b[k] for b in blocks if b["old"] != b["shard"] for k in ("old", "shard")}
    target = fresh_dir(spark, "reshard")
    if not affected:
        return target, {b["old"] for b in blocks}
    ends: dict[int, list] = {}
    for b in sorted(blocks, key=lambda b: (b["old"], b["first"])):
        ends.setdefault(b["old"], []).append(b)
    listed = [(old, b["shard"], b["first"], after["first"] if after else None)
              for old, row in ends.items() if old in affected for b, after in zip(row, [*row[1:], None])]
    borders = spark.createDataFrame(listed, "__old int, __shard int, __first struct<key:string,__row:long>, __next struct<key:string,__row:long>")
    here = F.struct(order_key().alias("key"), F.col("__row").alias("__row"))
    rows = laid.filter(F.col("__at").isin(sorted(affected))).withColumn("__place", here)
    within = (F.col("__at") == F.col("__old")) & (F.col("__place") >= F.col("__first")) & (F.col("__next").isNull() | (F.col("__place") < F.col("__next")))
    moved = rows.join(F.broadcast(borders), within).drop("__place", "__first", "__next", "__old", "__at", "__row")
    moved.write.option("compression", "zstd").partitionBy("__shard").parquet(target)
    before, written = sum(b["n"] for b in blocks if b["old"] in affected), spark.read.parquet(target).count()
    if before != written:
        raise ValueError(f"{before} rows of the affected shards, {written} rows written")
    return target, {b["old"] for b in blocks} - affected


def rewrite_affected(spark: SparkSession, folders: dict[int, str], placed: DataFrame, purpose: str = "reshard",
                     keys: tuple[str, ...] = ("doc_id",)) -> dict[int, str]:
    """New folders of the shards that gain or lose rows; the others keep theirs.

    ``folders``: the Parquet folder of each old shard.  ``placed``: the keys, old, shard.  Keys may be null and may repeat:
    the n-th row of a key in an old shard goes where the key's n-th placement says.  Only files of shards that lose or gain
    rows are read, and each is written once under a new name, so the old files stay valid until the caller switches over,
    whatever fails before that.  Other numbers of rows than before are an error.
    """
    moves = placed.filter("old <> shard").select("old", "shard").distinct().collect()  # at most old x new rows
    affected = {m[k] for m in moves for k in ("old", "shard")}
    if not affected:
        return dict(folders)
    kept = {i: path for i, path in folders.items() if i not in affected}
    target, columns = fresh_dir(spark, purpose), spark.read.parquet(next(iter(folders.values()))).columns
    place = {"__file": F.col("_metadata.file_path"), "__index": F.col("_metadata.row_index")}
    parts = [spark.read.parquet(path).withColumns(place | {"__old": F.lit(i)}) for i, path in folders.items() if i in affected]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    named = [f"__key{k}" for k in range(len(keys))]
    nth = lambda old, by, *order: F.row_number().over(Window.partitionBy(old, *by).orderBy(*order))
    plan = placed.filter(F.col("old").isin(sorted(affected))).select(
        *(F.col(k).alias(name) for k, name in zip(keys, named)), F.col("old").alias("__from"), F.col("shard").alias("__shard"))
    plan = plan.withColumn("__place", nth("__from", named, "__shard"))
    rows = rows.withColumn("__nth", nth("__old", keys, "__file", "__index"))
    same = (F.col("__old") == F.col("__from")) & (F.col("__nth") == F.col("__place"))
    for k, name in zip(keys, named):
        same = same & F.col(k).eqNullSafe(F.col(name))
    rows.join(plan, same).select(*columns, "__shard").write.partitionBy("__shard").parquet(target)
    before, written = sum(part.count() for part in parts), spark.read.parquet(target).count()
    if not before == written == plan.count():
        raise ValueError(f"{before} rows of the affected shards, {plan.count()} placements, {written} rows written")
    filled = placed.filter(F.col("shard").isin(sorted(affected))).select("shard").distinct().collect()
    return kept | {r["shard"]: f"{target}/__shard={r['shard']}" for r in filled}
