"""Session defaults shared by tests, the benchmark and ad-hoc use."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Batches that go to Python are bounded by rows alone; a thousand long texts still fit into a task.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.ui.enabled": "false",
    # Call sites are not recorded for every Column; queries here build thousands.
    "spark.sql.dataFrameQueryContext.enabled": "false",
}


def build_session(app: str = "lakesync", master: str | None = None, **conf: str) -> SparkSession:
    """Create (or reuse) a session with the engine's defaults; ``conf`` overrides them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def set_runtime_defaults(spark: SparkSession) -> None:
    """Apply the defaults that a running session still accepts (time zone above all)."""
    for key in ("spark.sql.session.timeZone", "spark.sql.adaptive.enabled",
                "spark.sql.adaptive.skewJoin.enabled", "spark.sql.dataFrameQueryContext.enabled",
                "spark.sql.execution.arrow.maxRecordsPerBatch"):
        spark.conf.set(key, DEFAULTS[key])
