"""File streams, drained with ``availableNow``."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lakesync.queries.changes import _APPLIED, change_events
from lakesync.queries.registry import query, table
from lakesync.streaming import incremental
from lakesync.workspace import fresh_dir


def _streamed(spark, rows: DataFrame, order: str) -> tuple[DataFrame, str, str]:
    """The rows as a stream of several files and micro-batches."""
    source = fresh_dir(spark, "stream-source")
    rows.repartitionByRange(6, order).write.parquet(source)
    stream = incremental.file_stream(spark, source, rows.schema, max_files=2)
    return stream, fresh_dir(spark, "stream-target"), fresh_dir(spark, "stream-checkpoint")


@query("stream_incremental_append", """
    SELECT event_id, user_id, value FROM events WHERE ts >= TIMESTAMP '2024-01-10'
""")
def stream_incremental_append(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "value", "ts")
    stream, target, checkpoint = _streamed(spark, events, "event_id")
    bound = F.to_timestamp_ntz(F.lit("2024-01-10"))
    return incremental.incremental_append(stream, target, checkpoint, F.col("ts") >= bound).drop("ts")


@query("stream_incremental_deduped", """
    SELECT user_id, event_id, value FROM (
        SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
    WHERE event_type <> 'error'
""")
def stream_incremental_deduped(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "value", "ts", "event_type")
    stream, target, checkpoint = _streamed(spark, events, "event_id")
    latest = incremental.incremental_deduped(
        stream, target, checkpoint, ["user_id"], ["ts", "event_id"], F.col("event_type") == "error"
    )
    return latest.select("user_id", "event_id", "value")


@query("stream_cdc_apply", _APPLIED)
def stream_cdc_apply(spark, sf_dir):
    stream, target, checkpoint = _streamed(spark, change_events(spark, sf_dir), "position")
    return incremental.change_stream(stream, target, checkpoint, ["user_id"], ["value", "props"], "position").select(
        "user_id", "value", "props"
    )
