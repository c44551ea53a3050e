"""Costs that follow the delta: bucketed winners, incremental history, snapshots, keyed streams."""

import pathlib

import pytest
from conftest import SPARK_ERRORS
from pyspark.sql import functions as F

from lakesync.operators import cdc, digests
from lakesync.operators.sync import StreamSpec, version_history
from lakesync.plans import sql
from lakesync.plans.history import closed_table, open_table, read_history, run_history
from lakesync.plans.sync_run import run_sync, winners_table
from lakesync.sources import buckets
from lakesync.streaming import files, incremental, keyed

AT = "2024-01-01T00:00:00Z"


def rows_of(spark, *rows):
    return spark.createDataFrame(list(rows), "k bigint, at bigint, v string")


def data_files(path):
    return sorted(p for p in pathlib.Path(path).rglob("*.parquet"))


def test_a_small_delta_rewrites_its_buckets_only(spark, store):
    spec = StreamSpec("t", ("k",), "at", "t")
    first = spark.range(20_000).select(F.col("id").alias("k"), F.lit(1).cast("bigint").alias("at"), F.format_string("a%d", "id").alias("v"))

    def run(rows, run_id):
        return run_sync(store, rows, spec, "incremental_append_deduped", run_id, AT, bucket_rows=500)

    run(first, "run1")
    old = buckets.load_version(spark, store.current(winners_table(spec))[-1].path)
    assert old.buckets == 64 and old.rows == 20_000
    result = run(rows_of(spark, (7, 2, "new"), (20_007, 2, "more"), (9, 1, "tie")), "run2")
    new = buckets.load_version(spark, store.current(winners_table(spec))[-1].path)
    changed = {b for b in new.parts if new.parts[b] != old.parts.get(b)}
    assert 1 <= len(changed) <= 3 and new.rows == 20_001 == result.records_loaded
    written = sum(p.stat().st_size for p in data_files(f"{new.path}/rows"))
    assert written * 10 < sum(p.stat().st_size for p in data_files(f"{old.path}/rows"))
    got = {r.k: r.v for r in store.read("t").where("k IN (7, 8, 9, 20007)").collect()}
    assert got == {7: "new", 8: "a8", 9: "tie", 20_007: "more"} and store.read("t").count() == 20_001


def test_buckets_are_split_when_they_have_grown(spark, store):
    spec = StreamSpec("t", ("k",), "at", "t")
    for k in range(5):
        part = spark.range(k * 1000, k * 1000 + 1500).select(F.col("id").alias("k"), F.lit(k).cast("bigint").alias("at"), F.lit(f"r{k}").alias("v"))
        run_sync(store, part, spec, "incremental_append_deduped", f"run{k}", AT, bucket_rows=250)
    version = buckets.load_version(spark, store.current(winners_table(spec))[-1].path)
    assert version.buckets > 8 and version.rows == 5500
    got = {r.v: r.n for r in store.read("t").groupBy("v").agg(F.count("*").alias("n")).collect()}
    assert got == {"r0": 1000, "r1": 1000, "r2": 1000, "r3": 1000, "r4": 1500}


def test_deleted_winners_and_new_columns_in_buckets(spark, store):
    spec = StreamSpec("t", ("k",), "at", "t")
    run_sync(store, rows_of(spark, (1, 1, "a"), (2, 1, "b")), spec, "incremental_append_deduped", "run1", AT)
    gone = spark.createDataFrame([(1, 2, "a", True), (3, 2, "c", False)], "k bigint, at bigint, v string, _deleted boolean")
    assert run_sync(store, gone, spec, "incremental_append_deduped", "run2", AT).records_loaded == 2
    assert sorted((r.k, r.v) for r in store.read("t").collect()) == [(2, "b"), (3, "c")]
    run_sync(store, rows_of(spark, (1, 3, "back")), spec, "incremental_append_deduped", "run3", AT)
    assert sorted((r.k, r.v) for r in store.read("t").collect()) == [(1, "back"), (2, "b"), (3, "c")]


def test_an_empty_first_run(spark, store):
    spec = StreamSpec("t", ("k",), "at", "t")
    run_sync(store, rows_of(spark, (1, 1, "a")).limit(0), spec, "incremental_append_deduped", "run1", AT)
    assert store.read("t").count() == 0
    run_sync(store, rows_of(spark, (1, 1, "a")), spec, "incremental_append_deduped", "run2", AT)
    assert store.read("t").count() == 1


# --- history

def test_history_over_runs_equals_one_pass_and_closed_files_stay(spark, store, rows):
    parts = [
        rows_of(spark, *((k, 1, "a") for k in range(300))),
        rows_of(spark, (5, 2, "b"), (5, 3, "c"), (400, 2, "n"), (6, 1, "a")),
        rows_of(spark, (5, 4, "d"), (400, 2, "n"), (400, 2, "n")),
        rows_of(spark, (1, 9, "z")).limit(0),
    ]
    seen = {}
    for n, part in enumerate(parts):
        run_history(store, part, "h", ["k"], ["at"], f"run{n}", bucket_rows=20)
        now = {p: p.stat().st_mtime_ns for c in store.current(closed_table("h")) for p in data_files(c.path)}
        assert seen.items() <= now.items()
        seen = now
    every = parts[0].union(parts[1]).union(parts[2]).distinct()
    want = version_history(every, ["k"], ["at"])
    columns = ("k", "at", "v", "valid_from", "valid_to", "is_current")
    assert rows(read_history(store, "h", ["at"]), *columns) == rows(want, *columns)
    opened = buckets.load_version(spark, store.current(open_table("h"))[-1].path)
    assert opened.rows == 301 and opened.buckets == 16


def test_late_rows_are_refused(spark, store):
    run_history(store, rows_of(spark, (1, 5, "a")), "h", ["k"], ["at"], "run1")
    with pytest.raises(SPARK_ERRORS, match="older than the open version"):
        run_history(store, rows_of(spark, (1, 4, "late")), "h", ["k"], ["at"], "run2")
    assert read_history(store, "h", ["at"]).count() == 1


# --- digests

def test_digests_find_what_a_full_join_finds(spark, tmp_path, rows):
    was = rows_of(spark, *((k, 1, f"v{k}") for k in range(3000)), (None, 1, "null key"))
    now = rows_of(spark, *((k, 1, "other" if k in (5, 1700) else f"v{k}") for k in range(3000) if k != 9), (5000, 1, "new"), (None, 1, "null key"))
    snapshot = digests.take_snapshot(was, ["k"], ["k", "at", "v"], str(tmp_path / "s"), bucket_rows=50)
    found = digests.changes_since(snapshot, now)
    assert rows(found, "k", "row_state") == sorted([(5, "changed"), (9, "deleted"), (1700, "changed"), (5000, "new")], key=repr)
    assert rows(digests.changed_rows(now, was, ["k"], ["k", "at", "v"], 64), "k", "row_state") == rows(found, "k", "row_state")
    assert snapshot.version.buckets == 64
    # Files of equal buckets are not opened.
    read = {p for p in found.inputFiles() if "/rows/" in p}
    assert 1 <= len(read) <= 4
    assert digests.changes_since(snapshot, was).count() == 0


# --- streams

def test_a_batch_writes_the_rows_of_its_own_keys(spark, tmp_path, rows):
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    frame = rows_of(spark, *((k, 1, "a") for k in range(2000)))
    frame.write.parquet(source)

    def drain():
        stream = files.file_stream(spark, source, frame.schema)
        return keyed.latest_rows(stream, ["k"], ["at"], target, checkpoint)

    assert drain().count() == 2000
    rows_of(spark, (3, 2, "b"), (3, 5, "c"), (2001, 1, "n"), (4, 0, "late")).coalesce(1).write.mode("append").parquet(source)
    after = drain()
    feed = keyed.Feed(after, target, ["k"])
    batches = feed._numbers(files.BATCH)
    assert spark.read.parquet(f"{target}/{files.BATCH}={batches[-1]}").count() == 3
    assert rows(after.where("k IN (3, 4, 2001)")) == [(2001, 1, "n"), (3, 5, "c"), (4, 1, "a")] and after.count() == 2001


def test_the_feed_is_folded(spark, tmp_path, rows, monkeypatch):
    monkeypatch.setattr(keyed, "FOLD_AFTER", 3)
    frame = rows_of(spark, (1, 1, "a"), (2, 1, "a"))
    feed = keyed.Feed(frame, str(tmp_path / "feed"), ["k"])
    feed.put(frame, 0)
    feed.put(rows_of(spark, (1, 2, "b")), 1)
    feed.fold()
    assert feed._numbers(files.BATCH) == [0, 1]
    feed.put(rows_of(spark, (3, 1, "c")), 2)
    feed.fold()
    assert (feed._numbers(files.BATCH), feed._numbers(keyed.BASE)) == ([], [2])
    feed.put(rows_of(spark, (2, 7, "d")), 3)
    assert rows(feed.read()) == [(1, 2, "b"), (2, 7, "d"), (3, 1, "c")]
    # A fold that did not end is not read.
    (tmp_path / "feed" / "_base=9").mkdir()
    assert feed.read().count() == 3


def test_change_streams_keep_values_that_were_not_sent(spark, tmp_path, rows):
    schema = "k int, position bigint, op string, v string, v_set boolean"
    parts = [
        [(1, 1, "insert", "a", True), (2, 2, "insert", "b", True)],
        [(1, 3, "update", None, False), (2, 4, "delete", None, True)],
        [(2, 5, "insert", None, False), (1, 6, "update", "c", True)],
    ]
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    want = []
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = files.file_stream(spark, source, spark.createDataFrame([], schema).schema)
        got = incremental.change_stream(stream, target, checkpoint, ["k"], ["v"], "position")
        want += part
        assert rows(got, "k", "v") == rows(cdc.apply_changes(spark.createDataFrame(want, schema), ["k"], ["v"], "position"), "k", "v")


# --- versions of relations

def test_versions_are_looked_up_without_a_shuffle_of_changes(spark, rows):
    changes = spark.range(3000).select((F.col("id") % 4).alias("relation_id"), F.col("id").alias("position"))
    listed = [(r, p, f"{r}:{p}") for r in range(4) for p in ([-5] + [7 * k * k + r for k in range(20)] + [2900 + k for k in range(30)])] + [(0, 7, "again"), (9, 3, "unused")]
    relations = spark.createDataFrame(listed, "relation_id bigint, position bigint, version string")
    small = cdc.bind_relations(changes, relations, ["version"])
    sorted_together = cdc.bind_relations(changes, relations.dropDuplicates(["relation_id", "position"]), ["version"], small_versions=0)
    exact = small.where("NOT (relation_id = 0 AND position >= 7 AND position < 28)")
    assert rows(exact) == rows(sorted_together.select(exact.columns).where("NOT (relation_id = 0 AND position >= 7 AND position < 28)"))
    assert small.count() == 3000
    assert "hashpartitioning" not in small._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]
    with pytest.raises(SPARK_ERRORS, match="before its relation"):
        cdc.bind_relations(changes, relations.where("relation_id <> 2"), ["version"]).collect()
    with pytest.raises(SPARK_ERRORS, match="before its relation"):
        cdc.bind_relations(changes, relations.limit(0), ["version"]).collect()


# --- recursion

CHAIN = "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 50) SELECT * FROM t"


def test_recursion_needs_a_bound_and_fails_beyond_it(spark):
    assert sql.query(spark, CHAIN, max_depth=60).count() == 50
    with pytest.raises(ValueError, match="needs max_depth"):
        sql.query(spark, CHAIN)
    with pytest.raises(SPARK_ERRORS, match="RECURSION"):
        sql.query(spark, CHAIN, max_depth=10).collect()
    with pytest.raises(ValueError, match="more than the 10"):
        sql.query(spark, CHAIN.replace("t(n) AS", "t(n) MAX RECURSION LEVEL 99 AS"), max_depth=10)
    assert sql.query(spark, "SELECT 'with recursive' AS x").count() == 1


# --- commit log

def test_a_writer_that_ended_before_its_line_stops_nobody(spark, store, rows):
    frame = spark.createDataFrame([(1,)], "k int")
    store.append("t", "run1", frame)
    commits = pathlib.Path(store.root) / "commits"
    (commits / f"{2:020d}.json").write_text("")
    (commits / f"{3:020d}.json").write_text('{"seq": 3, "run_')
    store.append("t", "run2", frame)
    assert [line.seq for line in store.log()] == [1, 4] and store.read("t").count() == 2


def test_stores_without_a_rename_are_refused(store):
    class Elsewhere:
        def makeQualified(self, _):
            return self

        def toUri(self):
            return self

        def getScheme(self):
            return "s3a"

    store._files = Elsewhere()
    with pytest.raises(ValueError, match="s3a"):
        store._create("1.json", "{}")
