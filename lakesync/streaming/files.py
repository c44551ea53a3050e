"""Folders of files as streams that are drained and then stop."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, types as T

BATCH = "_batch"


def file_stream(spark: SparkSession, path: str, schema: T.StructType, form: str = "parquet",
                max_files: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).format(form).option("maxFilesPerTrigger", max_files).load(path)


def drain(stream: DataFrame, checkpoint: str, land: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Process all files that are there now, then stop."""
    writer = stream.writeStream.foreachBatch(land).outputMode(mode).option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start().awaitTermination()
