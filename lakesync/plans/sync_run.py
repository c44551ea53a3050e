"""One sync run: a stream lands in raw history and final table under one of the five modes."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, functions as F, types as T

from lakesync.functions.cursor import cursor_kind
from lakesync.operators.mapping import SchemaMapper, map_schema
from lakesync.operators.sync import (
    StreamSpec, SyncMode, accept_from, check_stream, enrich, latest_per_key, latest_raw, max_cursor, parse_mode, raw_envelope,
    raw_order,
)
from lakesync.sources import buckets
from lakesync.sources.tables import BUCKETED, LIVE_BUCKETED, RECORDS, Change, StreamState, TableStore

DEFAULT_BATCH_ROWS = 1000


@dataclass(frozen=True)
class RunResult:
    """Checkpoint of a finished run."""

    run_id: str
    sync_mode: str
    records_read: int
    records_transformed: int
    records_loaded: int
    records_failed: int
    batches: int
    generation_id: int
    cursor: str | None


def raw_table(spec: StreamSpec) -> str:
    return f"_raw__{spec.name}__{spec.table or spec.name}"


def winners_table(spec: StreamSpec) -> str:
    return f"_latest__{spec.name}__{spec.table or spec.name}"


def accepted_rows(source: DataFrame, spec: StreamSpec, mode: SyncMode, prior: StreamState, kind: str | None) -> DataFrame:
    """Rows of the source that the run lands; the cursor bound stands next to the scan, so it can be pushed into it."""
    return accept_from(source, spec.cursor, prior.cursor, kind) if mode.incremental else source


def run_sync(
    store: TableStore, source: DataFrame, spec: StreamSpec, mode: str | SyncMode, run_id: str,
    run_at: str, batch_rows: int = DEFAULT_BATCH_ROWS, mapper: SchemaMapper | None = None,
    bucket_rows: int | None = None,
) -> RunResult:
    """Land ``source`` and publish the final table; nothing is visible unless all of it worked.

    ``mapper`` turns the source's columns into those that land; key and cursor are named as they land.

    New rows are shaped and written to raw history in one pass without a shuffle.  Deduplicated modes publish the winners of
    all raw history: kept winners cover the history up to the commit that wrote them, and what was landed since, by runs of
    any mode, is merged into them.  Counts come from the written files, so repeated tasks cannot inflate them.
    """
    mode = mode if isinstance(mode, SyncMode) else parse_mode(mode)
    check_stream(spec, mode)
    source = map_schema(source, mapper) if mapper else source
    log = store.log()
    store.check_new(run_id, log)
    prior = store.stream_state(spec.name, log)
    generation = prior.generation + 1 if mode.overwrite or not prior.generation else prior.generation
    kind = None
    if spec.cursor:
        kind = prior.cursor_kind or cursor_kind(source, spec.cursor)

    rows = accepted_rows(source, spec, mode, prior, kind)
    raw = raw_envelope(enrich(rows, run_id, run_at, spec.cursor), spec, run_id, generation, run_at)
    history = [] if mode.overwrite else store.numbered(raw_table(spec), log)
    store.schema_of([change for _, change in history], raw.schema)  # a column of another type is refused before anything is written
    raw_path = store.stage(raw_table(spec), run_id, raw)
    landed = store.read_paths([raw_path], raw.schema)

    newest = max_cursor(source, spec.cursor, kind) if spec.cursor else F.lit(None).cast("string")
    facts = landed.select("record.*").agg(F.count("*").alias("n"), newest.alias("cursor")).first()
    # A scan without columns where some rows were left out.
    read = facts.n if rows is source else source.count()
    changes = [Change(raw_table(spec), raw_path, raw.schema, mode.overwrite, facts.n)]

    # The final table is a view of files that are written anyway: raw history,
    # or the winners of it, in buckets of which a run writes those that its keys fall into.
    final = Change(spec.table or spec.name, raw_path, raw.schema, mode.overwrite, facts.n, RECORDS)
    if mode.deduped:
        version, schema = publish_winners(store, spec, kind, run_id, log, history, landed, facts.n, mode.overwrite, bucket_rows)
        changes.append(Change(winners_table(spec), version.path, schema, True, version.rows, BUCKETED))
        final = Change(spec.table or spec.name, version.path, schema, True, version.live, LIVE_BUCKETED)
    changes.append(final)

    cursor = later_cursor(store, prior.cursor, facts.cursor, text_kind(source, spec, kind))
    store.commit(run_id, changes, spec.name, StreamState(cursor, kind, generation), based_on=log)
    return RunResult(
        run_id, mode.name, read, facts.n, changes[-1].rows, 0,
        math.ceil(facts.n / max(batch_rows, 1)), generation, cursor,
    )


def publish_winners(
    store: TableStore, spec: StreamSpec, kind: str | None, run_id: str, log: list[Row], history: list[tuple[int, Row]],
    landed: DataFrame, n_landed: int, overwrite: bool, bucket_rows: int | None = None,
) -> tuple[buckets.Version, T.StructType]:
    """Stage the winners of the raw history (number of the commit, change) and of the rows just landed.

    Winners stand in buckets of their key.  Where the kept ones cover the history up to a commit, only what came since is
    reduced to its own winners, and only the buckets those fall into are read and written again.
    """
    path, key = store.fresh(winners_table(spec), run_id), ["_sync_primary_key"]
    live = ~F.col("_sync_deleted")
    kept = [] if overwrite else store.numbered(winners_table(spec), log)
    covered = kept[-1][0] if kept else 0
    # Winners from before the history began (it was overwritten since) are of no use.
    usable = covered and not (history and history[0][1].action == "replace" and history[0][0] > covered)
    since = [] if overwrite else [change for number, change in history if not usable or number > covered]
    new = landed.unionByName(store.read_changes(since), allowMissingColumns=True) if since else landed
    best = latest_raw(new, spec.cursor, kind)
    if not usable:
        rows = n_landed + sum(change.rows for change in since)
        return buckets.write_version(best, key, path, rows, live, bucket_rows), best.schema
    old = kept[-1][1]
    schema = store.schema_of([old], best.schema)
    best.write.parquet(f"{path}/delta")
    delta = store.read_paths([f"{path}/delta"], best.schema)

    def merge(rows: DataFrame, by: list[str]) -> DataFrame:
        return latest_per_key(rows, [*by, *key], raw_order(rows, spec.cursor, kind))

    return buckets.change_version(buckets.load_version(store.spark, old.path), schema, aligned(delta, schema), key, path, merge, live, bucket_rows), schema


def aligned(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows with all fields of a merged schema, nested ones too; missing ones are null."""
    return map_schema(df, lambda _: schema)


def text_kind(source: DataFrame, spec: StreamSpec, kind: str | None) -> str:
    """How the cursor text in the envelope is ordered; plain dates order as text."""
    if spec.cursor and isinstance(source.schema[spec.cursor].dataType, T.DateType):
        return "text"
    return kind or "text"


def later_cursor(store: TableStore, old: str | None, new: str | None, kind: str) -> str | None:
    """The greater of two cursor texts; old rows in a retry must not move the cursor back."""
    if not old or not new:
        return new or old
    both = store.spark.createDataFrame([(old,), (new,)], "cursor string")
    return both.agg(max_cursor(both, "cursor", kind).alias("c")).first().c
