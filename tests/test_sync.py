"""Sync modes: duplicates, safe publishing, cursors, tombstones, generations."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from conftest import SPARK_ERRORS
from pyspark.sql import functions as F

from lakesync.functions.cursor import cursor_kind, strictly_after
from lakesync.functions.values import is_deleted, plain_number
from lakesync.operators.sync import (
    StreamSpec, accept_from, check_stream, enrich, max_cursor, parse_mode, primary_key_text, raw_envelope,
)
from lakesync.plans.sync_run import accepted_rows, raw_table, run_sync
from lakesync.sources.tables import ConcurrentChange, StreamState

SPEC = StreamSpec("people", ("id",), "updated_at")
AT = "2026-02-01T00:00:00.000000Z"


def batch(spark, *rows):
    data = [(i, n, f"2026-{d}T00:00:00Z", x[0] if x else None) for i, n, d, *x in rows]
    return spark.createDataFrame(data, "id string, name string, updated_at string, _deleted boolean")


def sync(store, source, mode, run, **more):
    return run_sync(store, source, SPEC, mode, run, AT, **more)


def names(store):
    return sorted(r.name for r in store.read("people").collect())


def test_append_twice_keeps_duplicates(spark, store):
    source = batch(spark, ("a", "Ada", "01-01"), ("g", "Grace", "01-02"))
    sync(store, source, "full_refresh_append", "r1")
    result = sync(store, source, "full_refresh_append", "r2")
    assert names(store) == ["Ada", "Ada", "Grace", "Grace"]
    assert (result.records_read, result.records_loaded, result.batches, result.generation_id) == (2, 2, 1, 1)


def test_failed_overwrite_leaves_the_old_rows(spark, store):
    sync(store, batch(spark, ("a", "Ada", "01-01"), ("g", "Grace", "01-02")), "full_refresh_overwrite", "r1")
    broken = batch(spark, ("k", "Katherine", "01-03")).withColumn(
        "name", F.when(F.col("id") == "k", F.raise_error(F.lit("source failed"))).otherwise(F.col("name"))
    )
    with pytest.raises(SPARK_ERRORS):
        sync(store, broken, "full_refresh_overwrite", "r2")
    assert names(store) == ["Ada", "Grace"]
    assert store.stream_state("people").generation == 1
    good = sync(store, batch(spark, ("k", "Katherine", "01-03")), "full_refresh_overwrite", "r3")
    assert names(store) == ["Katherine"]
    assert good.generation_id == 2
    assert store.read(raw_table(SPEC)).count() == 1


def test_incremental_append_resends_the_row_at_the_cursor(spark, store):
    sync(store, batch(spark, ("a", "Ada", "01-01"), ("g", "Grace", "01-02")), "incremental_append", "r1")
    second = batch(spark, ("a", "Ada", "01-01"), ("g", "Grace again", "01-02"), ("k", "Katherine", "01-03"))
    result = sync(store, second, "incremental_append", "r2")
    assert names(store) == ["Ada", "Grace", "Grace again", "Katherine"]
    assert result.cursor == "2026-01-03T00:00:00Z"
    assert (result.records_read, result.records_transformed) == (3, 2)
    broken = batch(spark, ("z", "Zoe", "01-09")).withColumn("id", F.raise_error(F.lit("x")).cast("string"))
    with pytest.raises(SPARK_ERRORS):
        sync(store, broken, "incremental_append", "r3")
    assert store.stream_state("people").cursor == "2026-01-03T00:00:00Z"


def test_old_rows_do_not_move_the_cursor_back(spark, store):
    sync(store, batch(spark, ("a", "Ada", "01-05")), "full_refresh_append", "r1")
    assert sync(store, batch(spark, ("a", "Ada", "01-02")), "full_refresh_append", "r2").cursor == "2026-01-05T00:00:00Z"


def test_incremental_deduped(spark, store):
    sync(store, batch(spark, ("a", "Ada", "01-01"), ("g", "Grace", "01-02")), "incremental_append_deduped", "r1")
    result = sync(
        store,
        batch(
            spark, ("a", "Ada latest", "01-03"), ("g", "Grace resent", "01-02"), ("k", "Katherine", "01-04"),
            ("m", "Mary", "01-05", True),
        ),
        "incremental_append_deduped", "r2",
    )
    assert names(store) == ["Ada latest", "Grace resent", "Katherine"]
    assert (result.records_loaded, result.cursor) == (3, "2026-01-05T00:00:00Z")
    # An older row of a deleted key must not bring it back.
    sync(store, batch(spark, ("m", "Mary old", "01-05", False)), "incremental_append_deduped", "r3")
    assert names(store) == ["Ada latest", "Grace resent", "Katherine", "Mary old"]
    sync(store, batch(spark, ("m", "Mary", "01-06", True)), "incremental_append_deduped", "r4")
    assert names(store) == ["Ada latest", "Grace resent", "Katherine"]
    assert store.read(raw_table(SPEC)).count() == 8


def test_overwrite_deduped_uses_only_its_own_generation(spark, store):
    first = batch(spark, ("a", "old", "01-01"), ("a", "latest", "01-03"), ("g", "Grace", "01-02"))
    assert sync(store, first, "full_refresh_overwrite_deduped", "r1").records_loaded == 2
    assert names(store) == ["Grace", "latest"]
    second = batch(spark, ("a", "current", "01-05"), ("a", "stale", "01-04"))
    assert sync(store, second, "full_refresh_overwrite_deduped", "r2").generation_id == 2
    assert names(store) == ["current"]


def test_new_columns_in_a_later_run(spark, store):
    sync(store, batch(spark, ("a", "Ada", "01-01")), "incremental_append_deduped", "r1")
    wider = batch(spark, ("g", "Grace", "01-02")).withColumn("plan", F.lit("pro"))
    sync(store, wider, "incremental_append_deduped", "r2")
    assert sorted((r.name, r.plan) for r in store.read("people").collect()) == [("Ada", None), ("Grace", "pro")]


@pytest.mark.parametrize("mode", ["full_refresh_append", "full_refresh_overwrite", "incremental_append_deduped"])
def test_a_run_is_committed_once_and_its_repeat_changes_nothing(spark, store, mode):
    sync(store, batch(spark, ("a", "Ada", "01-01"), ("k", "Katherine", "01-02")), mode, "r1")
    with pytest.raises(ValueError, match="committed before"):
        sync(store, batch(spark, ("g", "Grace", "01-03")), mode, "r1")
    assert names(store) == ["Ada", "Katherine"]
    with pytest.raises(ValueError, match="committed before"):
        store.overwrite("people", "r1", batch(spark, ("g", "Grace", "01-03")))
    assert names(store) == ["Ada", "Katherine"]


def test_writers_at_once_lose_nothing(spark, store):
    def write(i):
        store.append("numbers", f"w{i}", spark.createDataFrame([(i,)], "n int"))
        return i

    with ThreadPoolExecutor(4) as pool:
        done = list(pool.map(write, range(8)))
    assert sorted(r.n for r in store.read("numbers").collect()) == done == list(range(8))
    assert [line.seq for line in store.log()] == list(range(1, 9))


def test_a_run_from_an_outdated_state_is_refused(spark, store):
    sync(store, batch(spark, ("a", "Ada", "01-01")), "incremental_append_deduped", "r1")
    log = store.log()
    sync(store, batch(spark, ("g", "Grace", "01-02")), "incremental_append_deduped", "r2")
    change = store.staged("people", "r3", batch(spark, ("z", "Zoe", "01-03")), replace=True)
    with pytest.raises(ConcurrentChange):
        store.commit("r3", [change], "people", based_on=log)
    assert names(store) == ["Ada", "Grace"]


def test_changes_of_mode_keep_all_raw_history(spark, store):
    def run(mode, run_id, *rows):
        sync(store, batch(spark, *rows), mode, run_id)
        return names(store)

    dedup = "incremental_append_deduped"
    run("incremental_append", "r1", ("a", "Ada", "01-01"), ("g", "Grace", "01-02"))
    assert run(dedup, "r2", ("k", "Katherine", "01-03")) == ["Ada", "Grace", "Katherine"]
    assert run("incremental_append", "r3", ("a", "Ada new", "01-04"), ("m", "Mary", "01-04")) == ["Ada", "Ada new", "Grace", "Katherine", "Mary"]
    assert run(dedup, "r4", ("g", "Grace new", "01-05")) == ["Ada new", "Grace new", "Katherine", "Mary"]
    assert run("full_refresh_overwrite", "r5", ("x", "Xenia", "01-06")) == ["Xenia"]
    assert run(dedup, "r6", ("y", "Yves", "01-07")) == ["Xenia", "Yves"]


@pytest.mark.parametrize("mode", ["incremental_append", "incremental_append_deduped"])
def test_a_column_that_goes_stays_in_older_rows(spark, store, mode):
    sync(store, batch(spark, ("a", "Ada", "01-01")), mode, "r1")
    sync(store, batch(spark, ("g", "Grace", "01-02")).drop("name"), mode, "r2")
    assert sorted((r.id, r.name) for r in store.read("people").collect()) == [("a", "Ada"), ("g", None)]
    with pytest.raises(ValueError, match="column record.id was string, now int"):
        sync(store, batch(spark, ("7", "Zoe", "01-03")).withColumn("id", F.col("id").cast("int")), mode, "r3")
    assert store.read("people").count() == 2


def test_the_cursor_bound_reaches_the_scan_of_a_run(spark, tmp_path):
    path = str(tmp_path / "events")
    spark.range(100).withColumn("payload", F.lit("x")).write.parquet(path)
    spec, mode = StreamSpec("events", ("id",), "id"), parse_mode("incremental_append_deduped")
    rows = accepted_rows(spark.read.parquet(path), spec, mode, StreamState("60", "number", 1), "number")
    envelope = raw_envelope(enrich(rows, "r", AT, "id"), spec, "r", 1, AT)
    plan = envelope._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id,60)" in plan.partition("PushedFilters")[2].splitlines()[0]
    assert envelope.count() == 40


@pytest.mark.parametrize("value,text", [
    (float("nan"), "NaN"), (float("inf"), "+Inf"), (float("-inf"), "-Inf"), (1e25, "1" + "0" * 25), (1e-19, "0." + "0" * 18 + "1"),
    (2e-19, "0." + "0" * 18 + "2"), (-0.0, "0"), (-1.5, "-1.5"), (12345678.25, "12345678.25"), (1.5e300, "15" + "0" * 299),
    (-123456789012.0, "-123456789012"), (0.001, "0.001"), (1.25e-5, "0.0000125"), (9007199254740993.0, "9007199254740992"),
])
def test_number_text(spark, value, text):
    assert spark.createDataFrame([(value,)], "d double").select(plain_number(F.col("d"))).first()[0] == text


def test_mode_names_and_requirements():
    assert parse_mode(None).name == "full_refresh_append"
    assert parse_mode(" Full_Refresh_Deduped ").name == "full_refresh_overwrite_deduped"
    with pytest.raises(ValueError):
        parse_mode("mirror")
    with pytest.raises(ValueError, match="cursor"):
        check_stream(StreamSpec("s", ("id",)), parse_mode("incremental_append"))
    with pytest.raises(ValueError, match="primary key"):
        check_stream(StreamSpec("s", (), "at"), parse_mode("incremental_append_deduped"))


def test_missing_cursor_and_key_fail(spark):
    frame = spark.createDataFrame([("a", " "), ("b", "2")], "id string, at string")
    with pytest.raises(SPARK_ERRORS, match="without a cursor"):
        enrich(frame, "r", AT, "at").collect()
    keyless = spark.createDataFrame([(None, 1)], "id string, n int")
    with pytest.raises(SPARK_ERRORS, match="in key column"):
        keyless.select(primary_key_text(keyless.schema, ["id", "n"])).collect()


def test_key_text(spark):
    frame = spark.createDataFrame([("x\"y", 2.0, 2.5, 12345678.25, True)], "a string, b double, c double, d double, e boolean")
    key = frame.select(primary_key_text(frame.schema, frame.columns)).first()[0]
    assert key == '["x\\"y","2","2.5","12345678.25","true"]'


@pytest.mark.parametrize("low,high", [
    ("2026-01-01T00:00:00Z", "2026-01-01T00:00:00.000000001Z"),
    ("2026-01-01T01:00:00+02:00", "2026-01-01T00:00:00Z"), ("9", "10"), ("-1.5", "1e3"),
    ("9007199254740992", "9007199254740993"), ("abc", "abd"),
])
def test_cursor_order(spark, low, high):
    frame = spark.createDataFrame([(high,), (low,)], "c string")
    assert frame.agg(max_cursor(frame, "c")).first()[0] == high
    kind = cursor_kind(frame, "c")
    after = frame.where(strictly_after(F.col("c"), frame.schema["c"].dataType, kind, low)).collect()
    assert [r.c for r in after] == [high]
    assert accept_from(frame, "c", low).count() == 2


def test_equal_times_in_different_zones(spark):
    frame = spark.createDataFrame([("2026-01-01T00:00:00Z",)], "c string")
    assert accept_from(frame, "c", "2026-01-01T00:00:00+00:00").count() == 1


def test_mixed_cursors_are_refused(spark):
    for values in (["2026-01-01T00:00:00Z", "7"], ["7", "x"]):
        frame = spark.createDataFrame([(v,) for v in values], "c string")
        with pytest.raises(ValueError, match="mixes kinds"):
            cursor_kind(frame, "c")


@pytest.mark.parametrize("ddl,value,deleted", [
    ("boolean", True, True), ("boolean", False, False), ("string", "false", False), ("string", "", False),
    ("string", " ", False), ("string", "2026-01-01", True), ("string", "False", True), ("int", 0, True),
    ("int", None, False), ("string", None, False),
])
def test_tombstones(spark, ddl, value, deleted):
    frame = spark.createDataFrame([(value,)], f"_upstream_deleted {ddl}")
    assert frame.select(is_deleted(frame.schema)).first()[0] is deleted


def test_time_text_is_utc_in_any_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        frame = spark.sql("SELECT TIMESTAMP'2026-01-01 00:00:00Z' AS at")
        text = frame.agg(max_cursor(frame, "at")).first()[0]
        assert text == "2026-01-01T00:00:00.000000Z"
        assert accept_from(frame, "at", text).count() == 1
        assert accept_from(frame, "at", "2026-01-01T00:00:00.000001Z").count() == 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
