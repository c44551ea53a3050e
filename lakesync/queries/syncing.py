"""Sync modes over events: key ``user_id``, cursor ``ts``, ``error`` marks a deleted row."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lakesync.functions.values import iso_micros, is_deleted
from lakesync.operators import digests, sync
from lakesync.operators.sync import StreamSpec
from lakesync.plans.history import read_history, run_history
from lakesync.plans.sync_run import RunResult, run_sync
from lakesync.queries.registry import query, table
from lakesync.queries.sources import ISO, RUN_AT
from lakesync.sources.tables import TableStore
from lakesync.workspace import fresh_dir

SPEC = StreamSpec("events", ("user_id",), "ts", "events")
RUN_2 = "2024-02-02T00:00:00.000000Z"


def marked_events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", "ts", "value", (F.col("event_type") == "error").alias("_deleted")
    )


@query("enrich_metadata", f"""
    SELECT event_id, 'run1' AS _sync_run_id, '{RUN_AT}' AS _sync_synced_at, event_type = 'error' AS _sync_deleted,
           strftime(ts, '{ISO}') AS _sync_cursor FROM events
""")
def enrich_metadata(spark, sf_dir):
    rows = sync.enrich(marked_events(spark, sf_dir), "run1", RUN_AT, "ts")
    return rows.select("event_id", "_sync_run_id", "_sync_synced_at", "_sync_deleted", "_sync_cursor")


@query("raw_envelope", f"""
    SELECT true AS id_ok, 'run1' AS run_id, CAST(3 AS BIGINT) AS generation_id, strftime(ts, '{ISO}') AS cursor,
           '["' || user_id || '","' || event_type || '"]' AS primary_key, event_type = 'error' AS deleted,
           event_id, value
    FROM events
""")
def raw_envelope(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("_deleted", F.col("event_type") == "error")
    spec = StreamSpec("events", ("user_id", "event_type"), "ts")
    raw = sync.raw_envelope(sync.enrich(events, "run1", RUN_AT, "ts"), spec, "run1", 3, RUN_AT)
    return raw.select(
        F.col("_sync_raw_id").rlike("^run1:[0-9]{19}$").alias("id_ok"), F.col("_sync_run_id").alias("run_id"),
        F.col("_sync_generation_id").alias("generation_id"), F.col("_sync_cursor").alias("cursor"),
        F.col("_sync_primary_key").alias("primary_key"), F.col("_sync_deleted").alias("deleted"),
        "record.event_id", "record.value",
    )


@query("primary_key_tuple", """
    SELECT o_orderkey, to_json([CAST(o_custkey AS VARCHAR), o_orderpriority, CAST(CAST(o_orderkey * 2 AS BIGINT) AS VARCHAR),
           CAST(o_orderkey + CAST(0.5 AS DOUBLE) AS VARCHAR), CAST(o_orderkey % 2 = 0 AS VARCHAR)])::VARCHAR AS pk
    FROM orders
""")
def primary_key_tuple(spark, sf_dir):
    key = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").withColumns(
        {"whole": (key * 2).cast("double"), "half": key + F.lit(0.5), "even": key % 2 == 0}
    )
    pk = sync.primary_key_text(orders.schema, ["o_custkey", "o_orderpriority", "whole", "half", "even"])
    return orders.select("o_orderkey", pk.alias("pk"))


@query("cursor_filter_inclusive", f"""
    SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events WHERE event_id <= (SELECT max(event_id) // 2 FROM events))
""")
def cursor_filter_inclusive(spark, sf_dir):
    events, store = table(spark, sf_dir, "events"), TableStore(spark, fresh_dir(spark, "store"))
    half = events.agg(F.max("event_id").alias("n")).first().n // 2
    first = run_sync(store, events.where(F.col("event_id") <= half), SPEC, "incremental_append", "run1", RUN_AT)
    bound = store.stream_state("events").cursor
    assert bound == first.cursor
    return sync.accept_from(events, "ts", bound).select("event_id")


MODES_IN_TURN = (
    "incremental_append", "incremental_append_deduped", "incremental_append", "incremental_append_deduped",
    "full_refresh_overwrite", "incremental_append_deduped",
)


@query("sync_mode_switch", """
    WITH bounds AS (SELECT epoch(min(o_orderdate))::BIGINT AS low, epoch(max(o_orderdate))::BIGINT AS high FROM orders),
    parts AS (SELECT o_custkey, o_orderdate, (epoch(o_orderdate)::BIGINT - low) * 6 // (high - low + 1) AS part FROM orders, bounds)
    SELECT 'history' AS state, o_custkey, strftime(max(o_orderdate), '%Y-%m-%d') AS newest FROM parts WHERE part <= 3 GROUP BY o_custkey
    UNION ALL
    SELECT 'overwritten', o_custkey, strftime(max(o_orderdate), '%Y-%m-%d') FROM parts WHERE part >= 4 GROUP BY o_custkey
    UNION ALL
    SELECT 'landed', part, CAST(count(*) AS VARCHAR) FROM parts GROUP BY part
""")
def sync_mode_switch(spark, sf_dir):
    """All orders, a sixth of their time per run, each run in another mode; deduplicated runs publish winners of all raw
    history.  Every order lands once."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    seconds = F.unix_timestamp("o_orderdate")
    low, high = orders.agg(F.min(seconds), F.max(seconds)).first()
    part = F.expr(f"(unix_timestamp(o_orderdate) - {low or 0}) * {len(MODES_IN_TURN)} div {(high or 0) - (low or 0) + 1}")
    store, spec, states = TableStore(spark, fresh_dir(spark, "store")), StreamSpec("orders", ("o_custkey",), "o_orderdate"), []
    landed = []
    for k, mode in enumerate(MODES_IN_TURN):
        run = run_sync(store, orders.where(part == k), spec, mode, f"run{k}", f"2024-02-0{k + 1}T00:00:00.000000Z")
        landed.append(("landed", k, str(run.records_transformed)))
        if k in (3, 5):
            newest = F.date_format("o_orderdate", "yyyy-MM-dd").alias("newest")
            states.append(store.read("orders").select(F.lit("history" if k == 3 else "overwritten").alias("state"), "o_custkey", newest))
    return states[0].unionByName(states[1]).unionByName(spark.createDataFrame(landed, states[0].schema))


@query("sync_schema_change", """
    SELECT c_custkey, c_name, NULL::VARCHAR AS c_mktsegment FROM customer WHERE c_custkey % 3 = 0
    UNION ALL SELECT c_custkey, NULL, NULL FROM customer WHERE c_custkey % 3 = 1
    UNION ALL SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey % 3 = 2
""")
def sync_schema_change(spark, sf_dir):
    """A column that one run lacks, and one that only a later run has: older rows keep theirs, others get nulls."""
    customers, store = table(spark, sf_dir, "customer"), TableStore(spark, fresh_dir(spark, "store"))
    for k, columns in enumerate((["c_custkey", "c_name"], ["c_custkey"], ["c_custkey", "c_name", "c_mktsegment"])):
        part = customers.where(F.col("c_custkey") % 3 == k).select(*columns)
        run_sync(store, part, StreamSpec("customer", ("c_custkey",)), "full_refresh_append", f"run{k}", RUN_AT)
    return store.read("customer").select("c_custkey", "c_name", "c_mktsegment")


@query("cursor_advance", f"""
    SELECT event_type, strftime(max(ts), '{ISO}') AS cursor_time, CAST(max(user_id) AS VARCHAR) AS cursor_number,
           max('k' || user_id) AS cursor_text FROM events GROUP BY event_type
""")
def cursor_advance(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        "event_type", iso_micros(F.col("ts")).alias("at"), F.col("user_id").cast("string").alias("n"),
        F.concat(F.lit("k"), F.col("user_id").cast("string")).alias("t"),
    )
    return events.groupBy("event_type").agg(
        sync.max_cursor(events, "at").alias("cursor_time"), sync.max_cursor(events, "n").alias("cursor_number"),
        sync.max_cursor(events, "t").alias("cursor_text"),
    )


@query("tombstone_detect", """
    SELECT event_id, event_type = 'error' OR event_id % 7 IN (4, 5, 6) OR event_id % 10 = 0 AS deleted FROM events
""")
def tombstone_detect(spark, sf_dir):
    key = F.col("event_id")
    marks = F.element_at(F.array(*map(F.lit, ["", " ", "false", None, "False", "2024-01-01", "yes"])), (key % 7 + 1).cast("int"))
    events = table(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("event_type") != "view", F.col("event_type") == "error").alias("_deleted"),
        marks.alias("_ab_cdc_deleted_at"), F.when(key % 10 == 0, 0).alias("_upstream_deleted"),
    )
    return events.select("event_id", is_deleted(events.schema).alias("deleted"))


@query("latest_per_key", """
    SELECT user_id, event_id, value FROM (
        SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
    WHERE event_type <> 'error'
""")
def latest_per_key(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "value", "ts", "event_type")
    latest = sync.latest_per_key(
        events, ["user_id"], [F.col("ts"), F.col("event_id")], deleted=F.col("event_type") == "error"
    )
    return latest.select("user_id", "event_id", "value")


_LINE_ORDER = [
    "l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax",
]


@query("latest_per_part", f"""
    SELECT l_partkey, l_orderkey, l_linenumber, l_extendedprice FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY {', '.join(c + ' DESC' for c in _LINE_ORDER)}) = 1
""")
def latest_per_part(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", *_LINE_ORDER)
    latest = sync.latest_per_key(lines, ["l_partkey"], [F.col(c) for c in _LINE_ORDER])
    return latest.select("l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice")


def two_runs(spark, sf_dir, mode: str) -> tuple[TableStore, list[RunResult]]:
    """First days, then a run that overlaps them."""
    events = marked_events(spark, sf_dir)
    store = TableStore(spark, fresh_dir(spark, "store"))
    early = events.where(F.col("ts") < F.to_timestamp_ntz(F.lit("2024-01-20")))
    late = events.where(F.col("ts") >= F.to_timestamp_ntz(F.lit("2024-01-10")))
    return store, [run_sync(store, early, SPEC, mode, "run1", RUN_AT), run_sync(store, late, SPEC, mode, "run2", RUN_2)]


def _final(spark, sf_dir, mode: str) -> DataFrame:
    store, _ = two_runs(spark, sf_dir, mode)
    return store.read("events").select("event_id", "user_id", "value", "_sync_run_id", "_sync_deleted", "_sync_cursor")


_OUT = f"event_id, user_id, value, run AS _sync_run_id, event_type = 'error' AS _sync_deleted, strftime(ts, '{ISO}') AS _sync_cursor"
_RUN_1 = "SELECT *, 'run1' AS run FROM events WHERE ts < TIMESTAMP '2024-01-20'"
_RUN_2 = "SELECT *, 'run2' AS run FROM events WHERE ts >= TIMESTAMP '2024-01-10'"
_NEW = f"{_RUN_2} AND ts >= (SELECT max(ts) FROM events WHERE ts < TIMESTAMP '2024-01-20')"


@query("full_refresh_append", f"SELECT {_OUT} FROM ({_RUN_1} UNION ALL {_RUN_2})")
def full_refresh_append(spark, sf_dir):
    return _final(spark, sf_dir, "full_refresh_append")


@query("full_refresh_overwrite", f"SELECT {_OUT} FROM ({_RUN_2})")
def full_refresh_overwrite(spark, sf_dir):
    return _final(spark, sf_dir, "full_refresh_overwrite")


@query("full_refresh_overwrite_deduped", f"""
    SELECT {_OUT} FROM (SELECT * FROM ({_RUN_2}) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) = 1)
    WHERE event_type <> 'error'
""")
def full_refresh_overwrite_deduped(spark, sf_dir):
    return _final(spark, sf_dir, "full_refresh_overwrite_deduped")


@query("incremental_append", f"SELECT {_OUT} FROM ({_RUN_1} UNION ALL {_NEW})")
def incremental_append(spark, sf_dir):
    return _final(spark, sf_dir, "incremental_append")


@query("incremental_append_deduped", f"""
    SELECT {_OUT} FROM (SELECT * FROM ({_RUN_1} UNION ALL {_NEW})
                        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, run DESC) = 1)
    WHERE event_type <> 'error'
""")
def incremental_append_deduped(spark, sf_dir):
    return _final(spark, sf_dir, "incremental_append_deduped")


_TWO_COUNTS = "(SELECT count(*) FROM events WHERE ts < TIMESTAMP '2024-01-20') AS n1, (SELECT count(*) FROM events WHERE ts >= TIMESTAMP '2024-01-10') AS n2"


@query("generation_id", """
    SELECT m AS sync_mode, r AS run_id, CAST(CASE WHEN r = 'run2' AND m LIKE '%overwrite%' THEN 2 ELSE 1 END AS BIGINT) AS generation_id,
           (SELECT count(*) FROM events WHERE CASE WHEN r = 'run1' THEN ts < TIMESTAMP '2024-01-20' ELSE ts >= TIMESTAMP '2024-01-10' END) AS records_read
    FROM (VALUES ('full_refresh_append'), ('full_refresh_overwrite')) a(m), (VALUES ('run1'), ('run2')) b(r)
""")
def generation_id(spark, sf_dir):
    runs = [r for m in ("full_refresh_append", "full_refresh_overwrite") for r in two_runs(spark, sf_dir, m)[1]]
    return results_frame(spark, runs).select("sync_mode", "run_id", "generation_id", "records_read")


def results_frame(spark, runs: list[RunResult]) -> DataFrame:
    schema = (
        "run_id string, sync_mode string, records_read bigint, records_transformed bigint, records_loaded bigint, "
        "records_failed bigint, batches bigint, generation_id bigint, cursor string"
    )
    return spark.createDataFrame([tuple(vars(r).values()) for r in runs], schema)


@query("run_checkpoint", f"""
    WITH both_runs AS ({_RUN_1} UNION ALL {_NEW}),
         sizes AS (SELECT run AS run_id, count(*) AS n, strftime(max(ts), '{ISO}') AS cursor FROM both_runs GROUP BY run),
         kept AS (SELECT 'run1' AS run_id, (SELECT count(*) FROM (SELECT * FROM ({_RUN_1})
                    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) = 1) WHERE event_type <> 'error') AS loaded
                  UNION ALL
                  SELECT 'run2', (SELECT count(*) FROM (SELECT * FROM both_runs
                    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, run DESC) = 1) WHERE event_type <> 'error'))
    SELECT run_id, 'incremental_append_deduped' AS sync_mode, CASE run_id WHEN 'run1' THEN n1 ELSE n2 END AS records_read,
           n AS records_transformed, loaded AS records_loaded, CAST(0 AS BIGINT) AS records_failed,
           CAST(ceil(n / 1000) AS BIGINT) AS batches, CAST(1 AS BIGINT) AS generation_id, cursor
    FROM sizes JOIN kept USING (run_id), (SELECT {_TWO_COUNTS})
""")
def run_checkpoint(spark, sf_dir):
    return results_frame(spark, two_runs(spark, sf_dir, "incremental_append_deduped")[1])


@query("sync_history_scd2", f"""
    SELECT user_id, event_id, strftime(ts, '{ISO}') AS valid_from,
           strftime(lead(ts) OVER w, '{ISO}') AS valid_to, lead(ts) OVER w IS NULL AS is_current
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
""")
def sync_history_scd2(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    history = sync.version_history(events, ["user_id"], ["ts", "event_id"])
    return history.select(
        "user_id", "event_id", iso_micros(F.col("valid_from")).alias("valid_from"),
        iso_micros(F.col("valid_to")).alias("valid_to"), "is_current",
    )


@query("sync_history_incremental", f"""
    SELECT user_id, event_id, strftime(ts, '{ISO}') AS valid_from,
           strftime(lead(ts) OVER w, '{ISO}') AS valid_to, lead(ts) OVER w IS NULL AS is_current
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
""")
def sync_history_incremental(spark, sf_dir):
    """The same history in three runs that overlap; a run touches the open versions of its own keys only."""
    events, store = table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), TableStore(spark, fresh_dir(spark, "store"))
    days = [F.to_timestamp_ntz(F.lit(day)) for day in ("2024-01-10", "2024-01-20")]
    at = F.col("ts")
    for k, rows in enumerate((events.where(at < days[0]), events.where((at >= days[0]) & (at < days[1])), events.where(at >= days[1]))):
        run_history(store, rows, "events", ["user_id"], ["ts", "event_id"], f"run{k}")
    history = read_history(store, "events", ["ts", "event_id"])
    return history.select(
        "user_id", "event_id", iso_micros(F.col("valid_from")).alias("valid_from"),
        iso_micros(F.col("valid_to")).alias("valid_to"), "is_current",
    )


@query("changed_rows_by_digest", """
    SELECT o_orderkey, CASE WHEN o_orderkey % 331 = 0 THEN 'new' WHEN o_orderkey % 331 = 1 THEN 'deleted' ELSE 'changed' END AS row_state,
           CASE WHEN o_orderkey % 331 <> 1 THEN sha256('o_custkey=' || o_custkey || ';o_orderkey=' || o_orderkey || ';o_orderstatus="' || o_orderstatus || '";') END AS source_signature
    FROM orders WHERE o_orderkey % 331 IN (0, 1) OR o_orderkey % 337 = 0
""")
def changed_rows_by_digest(spark, sf_dir):
    """Orders against a snapshot in which one in a hundred stands otherwise; equal buckets are not read."""
    key, columns = F.col("o_orderkey"), ["o_orderkey", "o_custkey", "o_orderstatus"]
    orders = table(spark, sf_dir, "orders").select(*columns)
    was = orders.where(key % 331 != 0).withColumn("o_custkey", F.when(key % 337 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")))
    snapshot = digests.take_snapshot(was, ["o_orderkey"], columns, fresh_dir(spark, "snapshot"), bucket_rows=2000)
    changed = digests.changes_since(snapshot, orders.where(key % 331 != 1))
    return changed.select("o_orderkey", "row_state", "source_signature")


@query("row_signatures_unchanged", """
    SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'new' WHEN o_orderkey % 10 = 1 THEN 'deleted'
                            WHEN o_orderkey % 7 = 0 THEN 'changed' ELSE 'unchanged' END AS row_state,
           CASE WHEN o_orderkey % 10 <> 1 THEN sha256('o_custkey=' || o_custkey || ';o_orderkey=' || o_orderkey || ';o_orderstatus="' || o_orderstatus || '";') END AS source_signature
    FROM orders
""")
def row_signatures_unchanged(spark, sf_dir):
    key = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    source = orders.where(key % 10 != 1)
    destination = orders.where(key % 10 != 0).withColumn(
        "o_custkey", F.when(key % 7 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey"))
    )
    columns = ["o_orderkey", "o_custkey", "o_orderstatus"]
    compared = sync.compare_signatures(source, destination, ["o_orderkey"], columns)
    return compared.select("o_orderkey", "row_state", "source_signature")
