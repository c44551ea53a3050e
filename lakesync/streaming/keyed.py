"""Streams with one current row per key, kept in Spark's state store.

A streaming aggregation holds the current row of every key in the state store (RocksDB, with change logs), and a micro-batch
reads and writes the state of its own keys only.  What it yields, the new rows of those keys, is appended to a feed under the
batch's number; the newest row of a key is the key's row.  Every ``FOLD_AFTER`` batches the feed is folded into one table,
so that reading does not grow with the number of batches.  A batch that runs again replaces its own part of the feed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from lakesync.operators.sync import latest_per_key
from lakesync.streaming.files import BATCH, drain

FOLD_AFTER = 64
BASE = "_base"
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


class Feed:
    """The rows that micro-batches yielded, below one folder: ``_batch=N`` and folds of all batches up to one, ``_base=N``."""

    def __init__(self, like: DataFrame, root: str, keys: Sequence[str]):
        self.spark, self.root, self.keys = like.sparkSession, root.rstrip("/"), list(keys)
        self.schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in like.schema.fields])
        jvm = self.spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.root).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self, kind: str) -> list[int]:
        """Numbers of the finished parts of one kind."""
        if not self._files.exists(self._path(self.root)):
            return []
        names = [status.getPath().getName() for status in self._files.listStatus(self._path(self.root))]
        found = [int(n.partition("=")[2]) for n in names if n.startswith(f"{kind}=")]
        return sorted(n for n in found if self._files.exists(self._path(f"{self.root}/{kind}={n}/_SUCCESS")))

    def put(self, rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.root}/{BATCH}={number}")

    def read(self) -> DataFrame:
        """The newest row of every key."""
        bases, batches = self._numbers(BASE), self._numbers(BATCH)
        folded = bases[-1] if bases else -1
        parts = [(f"{self.root}/{BASE}={folded}", folded)] if bases else []
        parts += [(f"{self.root}/{BATCH}={n}", n) for n in batches if n > folded]
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(*(path for path, _ in parts))
        # The part's number is in the path of its files.
        number = F.regexp_extract(F.col("_metadata.file_path"), rf"/(?:{BASE}|{BATCH})=(\d+)/[^/]*$", 1).cast("bigint")
        return latest_per_key(rows.withColumn("__part", number), self.keys, [F.col("__part")]).drop("__part")

    def fold(self) -> None:
        """Fold finished batches where there are many; what was folded is removed afterwards."""
        bases, batches = self._numbers(BASE), self._numbers(BATCH)
        fresh = [n for n in batches if not bases or n > bases[-1]]
        if len(fresh) >= FOLD_AFTER:
            self.read().write.mode("overwrite").parquet(f"{self.root}/{BASE}={fresh[-1]}")
            for kind, number in [(BASE, n) for n in bases] + [(BATCH, n) for n in batches]:
                self._files.delete(self._path(f"{self.root}/{kind}={number}"), True)


def keyed(stream: DataFrame, keys: Sequence[str], folds: Sequence[Column], target: str, checkpoint: str) -> DataFrame:
    """One row per key with ``folds`` over all its rows so far: the state after all files that are there now.

    ``folds`` are aggregates whose state is small, such as ``max`` and ``max_by``.
    """
    spark = stream.sparkSession
    folded = stream.groupBy(*keys).agg(*folds)
    feed = Feed(folded, target, keys)
    before = {name: spark.conf.get(name, None) for name in STATE_SETTINGS}
    for name, value in STATE_SETTINGS.items():
        spark.conf.set(name, value)
    try:
        drain(folded, checkpoint, feed.put, mode="update")
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)
    feed.fold()
    return feed.read()


def latest_rows(stream: DataFrame, keys: Sequence[str], order: Sequence[str], target: str, checkpoint: str) -> DataFrame:
    """The row of every key that is greatest by ``order``."""
    row = F.max_by(F.struct(*stream.columns), F.struct(*order)).alias("__row")
    return keyed(stream, keys, [row], target, checkpoint).select("__row.*")
