"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Every query runs to a full materialisation of its result (``noop`` sink).  A
first pass warms the JVM; the time reported is that of the second pass.
``records_per_second`` relates the sync queries to the published sync-loop
"""

from __future__ import annotations

import json
import os
import sys
import time


from lakesync.operators.sync import StreamSpec
from lakesync.plans.sync_run import run_sync
from lakesync.queries import all_queries
from lakesync.queries.registry import table
from lakesync.session import build_session
from lakesync.sources.tables import TableStore
from lakesync.workspace import fresh_dir

HEADLINE = (
    "latest_per_key", "latest_per_part", "incremental_append_deduped", "full_refresh_append", "sync_history_scd2",
    "row_signatures_unchanged", "src_jsonl", "records_at_path", "explode_child_rows", "computed_columns",
    "infer_types", "validate_rows_against_schema", "join_inner_agg", "join_asof", "join_range", "agg_rollup", "win_frame",
    "score_weighted", "score_validate", "dup_keys", "redact_text", "clean_control_chars", "plan_hash", "action_dedupe",
    "batch_assign", "cdc_events", "cdc_apply", "run_ledger_upsert", "token_estimate", "latest_order_totals",
    "route_requests", "set_except",
)
RUN_AT = "2024-02-01T00:00:00.000000Z"


RUN_2_AT = "2024-02-02T00:00:00.000000Z"
#: Rows from this day on, about one in a hundred, are left for the second run.
DELTA_FROM = "2001-10-11"


def sync_lineitem(spark, sf_dir: str, mode: str) -> tuple[float, int, float]:
    """One whole sync run over ``lineitem`` (land raw history, publish the final table, commit), and a second one that
    reads the whole source again and finds a small delta behind the stored cursor."""
    source = table(spark, sf_dir, "lineitem")
    spec = StreamSpec("lineitem", ("l_orderkey", "l_linenumber"), "l_shipdate")
    store = TableStore(spark, fresh_dir(spark, "store"))
    start = time.perf_counter()
    result = run_sync(store, source.where(source.l_shipdate < DELTA_FROM), spec, mode, "run1", RUN_AT)
    first = time.perf_counter()
    run_sync(store, source, spec, mode, "run2", RUN_2_AT)
    return first - start, result.records_read, time.perf_counter() - first


def timed(spark, run, sf_dir: str) -> float:
    start = time.perf_counter()
    run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    # Tables that jobs write go below this folder where it is given, else below the warehouse.
    shared = {"spark.checkpoint.dir": os.environ["BENCH_SHARED_DIR"]} if os.environ.get("BENCH_SHARED_DIR") else {}
    spark = build_session(
        "bench", f"local[{cpus}]", **shared, **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g",
           "spark.sql.files.openCostInBytes": "1m"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = all_queries(), {}
    for name in HEADLINE:
        timed(spark, queries[name], sf_dir)
        seconds[name] = round(timed(spark, queries[name], sf_dir), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr)
    rates = {}
    for mode in ("full_refresh_append", "full_refresh_overwrite_deduped", "incremental_append_deduped"):
        sync_lineitem(spark, sf_dir, mode)
        took, records, second = sync_lineitem(spark, sf_dir, mode)
        seconds[f"sync_lineitem_{mode}"] = round(took, 3)
        if mode.startswith("incremental"):
            seconds[f"sync_lineitem_{mode}_second_run"] = round(second, 3)
        rates[mode] = round(records / took, 1)
        print(f"sync_lineitem_{mode}: {took:.3f}", file=sys.stderr)
    print(json.dumps({
        "metric": "total_headline_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "sync_records_per_second": rates, "baseline_records_per_second": 3917.75,
    }))


if __name__ == "__main__":
    main()
