"""Where jobs put the tables they write for themselves.

Every such table goes below the shared folder the cluster names in
``spark.checkpoint.dir``.  A session without that setting uses its warehouse
folder, which driver and executors share as well.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def shared_root(spark: SparkSession) -> str:
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return configured.rstrip("/")


def fresh_dir(spark: SparkSession, purpose: str) -> str:
    """A new, never reused path for one run of one job."""
    return f"{shared_root(spark)}/lakesync/{purpose}/{uuid.uuid4().hex}"
