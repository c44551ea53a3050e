"""Version history kept run by run: open versions in buckets of their key, closed ones in files that are never touched again.

A run reads the open versions of the buckets that its keys fall into, closes those that have a successor, appends them to the
closed ones and writes the new open ones.  Its cost follows its rows, not the length of the history.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F, types as T

from lakesync.operators.sync import version_history
from lakesync.sources import buckets
from lakesync.sources.tables import BUCKETED, Change, TableStore

FROM, TO, CURRENT = "valid_from", "valid_to", "is_current"


def open_table(name: str) -> str:
    return f"_open__{name}"


def closed_table(name: str) -> str:
    return f"_closed__{name}"


def _checked(rows: DataFrame, order: Sequence[str], keys: Sequence[str], by: list[str]) -> DataFrame:
    """Old open versions and new rows of the same keys, each new row once; one from before the open version fails the run."""
    place = F.struct(*order)
    key = Window.partitionBy(*by, *keys)
    opened = F.max(F.when(F.col("__old"), place)).over(key)
    late = F.raise_error(F.lit("a row is older than the open version of its key")).cast("boolean")
    fits = F.when(opened.isNull() | (place >= opened), F.lit(True)).otherwise(late)
    again = F.row_number().over(Window.partitionBy(*by, *keys, *order).orderBy(F.col("__old").desc()))
    return rows.withColumns({"__fits": fits, "__again": again}).where(F.col("__fits") & (F.col("__again") == 1)).drop("__fits", "__again")


def run_history(
    store: TableStore, source: DataFrame, name: str, keys: Sequence[str], order: Sequence[str], run_id: str,
    bucket_rows: int | None = None,
) -> tuple[int, int]:
    """Add the rows of a run to a history; returns the numbers of open and of newly closed versions.

    ``order`` is unique within a key and starts with the column that versions are valid from.  A row that stands already as the
    open version of its key changes nothing; an older one is refused, since an incremental run never lets it through.
    """
    log = store.log()
    store.check_new(run_id, log)
    kept = store.current(open_table(name), log)
    path = store.fresh(open_table(name), run_id)
    delta = store.spark.read.schema(source.schema).parquet(_staged(source, f"{path}/delta"))

    if kept:
        old = buckets.load_version(store.spark, kept[-1].path)
        schema = store.schema_of(kept, source.schema)
    else:
        old, schema = buckets.write_version(delta.limit(0), keys, f"{path}/empty", delta.count(), bucket_rows=bucket_rows), source.schema

    # Which versions close is decided once, over the buckets that the run meets; both tables are written from that.
    joined = _with_old(store, old, schema, delta, keys)
    whole = _checked(joined, order, keys, [])
    versions = version_history(whole, keys, order).drop("__old")
    decided = store.spark.read.schema(versions.schema).parquet(_staged(versions, f"{path}/versions"))
    closed = decided.where(~F.col(CURRENT)).drop(CURRENT)
    closed_path = store.stage(closed_table(name), run_id, closed)
    n_closed = store.read_paths([closed_path], closed.schema).count()

    def newest(rows: DataFrame, by: list[str]) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*by, *keys).orderBy(*(F.col(o).desc() for o in order)))
        return rows.withColumn("__place", place).where(F.col("__place") == 1).drop("__place")

    opened = decided.where(F.col(CURRENT)).select(*source.columns)
    version = buckets.change_version(old, schema, opened, keys, path, newest, bucket_rows=bucket_rows)
    store.commit(run_id, [
        Change(closed_table(name), closed_path, closed.schema, False, n_closed),
        Change(open_table(name), path, schema, True, version.rows, BUCKETED),
    ], based_on=log)
    return version.rows, n_closed


def _staged(df: DataFrame, path: str) -> str:
    df.write.parquet(path)
    return path


def _with_old(store: TableStore, old: buckets.Version, schema: T.StructType, delta: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of a run and the open versions of its keys."""
    met = [r[0] for r in delta.select(buckets.bucket_of(keys, old.buckets)).distinct().collect()]  # at most one per bucket
    known = buckets.read_version(store.spark, old, schema, met).join(delta.select(*keys).distinct(), list(keys), "left_semi")
    return known.withColumn("__old", F.lit(True)).unionByName(delta.withColumn("__old", F.lit(False)), allowMissingColumns=True)


def read_history(store: TableStore, name: str, order: Sequence[str]) -> DataFrame:
    """All versions with their validity; the open ones are current."""
    opened = store.read(open_table(name))
    start = F.col(f"`{order[0]}`")
    none = F.lit(None).cast(opened.schema[order[0]].dataType)
    current = opened.withColumns({TO: none, FROM: start, CURRENT: F.lit(True)})
    past = store.read(closed_table(name)).withColumn(CURRENT, F.lit(False))
    return past.unionByName(current, allowMissingColumns=True)
