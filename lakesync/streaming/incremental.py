"""File streams into tables: incremental append, incremental deduplicated, change apply.

What a micro-batch writes stands under the batch number, so a batch that is run
again after a failure replaces its own rows.  Appended batches are the result.
Deduplicated and change streams keep one row per key in the state store (see
``keyed``), so a batch costs what its own keys cost.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, types as T

from lakesync.operators.cdc import change_folds, current_rows
from lakesync.streaming import keyed
from lakesync.streaming.files import BATCH, drain, file_stream

__all__ = ["change_stream", "file_stream", "incremental_append", "incremental_deduped", "land_batches"]

def land_batches(
    stream: DataFrame, target: str, checkpoint: str, shape: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Stage each micro-batch under its number; returns all staged rows so far."""
    def land(batch: DataFrame, number: int) -> None:
        shape(batch).write.mode("overwrite").parquet(f"{target}/{BATCH}={number}")

    drain(stream, checkpoint, land)
    schema = shape(stream).schema
    full = T.StructType([*schema.fields, T.StructField(BATCH, T.LongType())])
    return stream.sparkSession.read.schema(full).parquet(target)


def incremental_append(
    stream: DataFrame, target: str, checkpoint: str, accept: Column | None = None
) -> DataFrame:
    """Append accepted rows; state moves on only after their batch is written."""
    return land_batches(
        stream, target, checkpoint, lambda b: b if accept is None else b.where(accept)
    ).drop(BATCH)


def incremental_deduped(
    stream: DataFrame, target: str, checkpoint: str, keys: list[str], order: list[str], deleted: Column
) -> DataFrame:
    """Latest row per key across all batches; winners are kept with the deleted ones, which stay deleted."""
    return keyed.latest_rows(stream, keys, order, target, checkpoint).where(~deleted)


def change_stream(
    stream: DataFrame, target: str, checkpoint: str, keys: list[str], columns: list[str], position: str
) -> DataFrame:
    """Current table from a stream of change events; the state is the folded log, deleted keys included."""
    folds = change_folds(stream, columns, position)
    return current_rows(keyed.keyed(stream, keys, folds, target, checkpoint), keys, columns, position)
