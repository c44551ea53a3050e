"""Row-level pieces of the sync modes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from lakesync.functions.cursor import cursor_kind, cursor_sort_key, cursor_text, not_before, required_cursor
from lakesync.functions.values import comparable_text, hash_bits, is_deleted, row_hash
from lakesync.operators.ordered import with_frame

# Mode names, their spelling variants, and what each one means.
MODES = {
    "full_refresh_append": ("full", "append"),
    "full_refresh_overwrite": ("full", "overwrite"),
    "full_refresh_overwrite_deduped": ("full", "overwrite_deduped"),
    "incremental_append": ("incremental", "append"),
    "incremental_append_deduped": ("incremental", "append_deduped"),
}
MODE_VARIANTS = {
    "full_refresh_overwrite_dedup": "full_refresh_overwrite_deduped",
    "full_refresh_deduped": "full_refresh_overwrite_deduped",
    "incremental_append_dedup": "incremental_append_deduped",
}
DEFAULT_MODE = "full_refresh_append"


@dataclass(frozen=True)
class SyncMode:
    name: str
    source: str
    destination: str

    @property
    def incremental(self) -> bool:
        return self.source == "incremental"

    @property
    def deduped(self) -> bool:
        return self.destination.endswith("deduped")

    @property
    def overwrite(self) -> bool:
        return self.destination.startswith("overwrite")


@dataclass(frozen=True)
class StreamSpec:
    """Key, cursor and target of one stream."""

    name: str
    primary_key: tuple[str, ...] = ()
    cursor: str | None = None
    table: str | None = None
    order_key: tuple[str, ...] = field(default=())


def parse_mode(name: str | None) -> SyncMode:
    wanted = (name or "").strip().lower() or DEFAULT_MODE
    wanted = MODE_VARIANTS.get(wanted, wanted)
    if wanted not in MODES:
        raise ValueError(f"no such sync mode: {name!r}")
    return SyncMode(wanted, *MODES[wanted])


def check_stream(spec: StreamSpec, mode: SyncMode) -> None:
    if (mode.incremental or mode.deduped) and not (spec.cursor or "").strip():
        raise ValueError(f"{mode.name} needs a cursor field")
    if mode.deduped and not spec.primary_key:
        raise ValueError(f"{mode.name} needs a primary key")


def enrich(df: DataFrame, run_id: str, synced_at: str, cursor: str | None = None) -> DataFrame:
    """Add run id, time of the run, deletion flag and cursor text to every row."""
    added = {
        "_sync_run_id": F.lit(run_id),
        "_sync_synced_at": F.lit(synced_at),
        "_sync_deleted": is_deleted(df.schema),
    }
    if cursor:
        added["_sync_cursor"] = required_cursor(F.col(f"`{cursor}`"), df.schema[cursor].dataType, cursor)
    return df.withColumns(added)


def primary_key_text(schema: T.StructType, keys: Sequence[str]) -> Column:
    """JSON array of the key values as text; a null key value fails the job."""
    if not keys:
        raise ValueError("no key columns given")
    parts = []
    for name in keys:
        text = comparable_text(F.col(f"`{name}`"), schema[name].dataType)
        missing = F.raise_error(F.lit(f"row without a value in key column {name}")).cast("string")
        parts.append(F.coalesce(text, missing))
    return F.to_json(F.array(*parts))


def accept_from(df: DataFrame, cursor: str, bound: str | None, kind: str | None = None) -> DataFrame:
    """Drop rows before the stored cursor; rows at the cursor stay."""
    if not bound:
        return df
    dtype = df.schema[cursor].dataType
    return df.where(not_before(F.col(f"`{cursor}`"), dtype, kind or cursor_kind(df, cursor), bound))


def max_cursor(df: DataFrame, cursor: str, kind: str | None = None) -> Column:
    """Aggregate: text of the greatest cursor."""
    dtype = df.schema[cursor].dataType
    col = F.col(f"`{cursor}`")
    keys = cursor_sort_key(col, dtype, kind or cursor_kind(df, cursor))
    if not isinstance(dtype, T.StringType):
        return cursor_text(F.max(col), dtype)
    return F.max_by(cursor_text(col, dtype), F.struct(*keys))


def raw_envelope(
    df: DataFrame, spec: StreamSpec, run_id: str, generation: int, extracted_at: str
) -> DataFrame:
    """Raw history rows around enriched records.

    Raw ids carry the run id and a sequence number that is unique and ordered
    within a partition; no step numbers the whole table in one task.
    """
    sequence = F.lpad(F.monotonically_increasing_id().cast("string"), 19, "0")
    key = primary_key_text(df.schema, spec.primary_key) if spec.primary_key else F.lit("")
    return df.select(
        F.concat(F.lit(f"{run_id}:"), sequence).alias("_sync_raw_id"),
        F.lit(run_id).alias("_sync_run_id"),
        F.lit(run_id).alias("_sync_sync_id"),
        F.lit(generation).cast("bigint").alias("_sync_generation_id"),
        F.lit(extracted_at).alias("_sync_extracted_at"),
        F.lit(extracted_at).alias("_sync_loaded_at"),
        (F.col("_sync_cursor") if "_sync_cursor" in df.columns else F.lit("")).alias("_sync_cursor"),
        key.alias("_sync_primary_key"),
        F.col("_sync_deleted"),
        F.struct(*df.columns).alias("record"),
    )


def latest_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], deleted: Column | None = None
) -> DataFrame:
    """One row per key: the greatest by ``order``; a key whose winner is deleted disappears.

    The row limit of one reaches below the shuffle, so each task sends at most
    one row per key and a hot key costs no more than any other.
    """
    window = Window.partitionBy(*keys).orderBy(*(o.desc_nulls_last() for o in order))
    winners = df.withColumn("__rank", F.row_number().over(window)).where(F.col("__rank") == 1)
    winners = winners.drop("__rank")
    return winners if deleted is None else winners.where(~deleted)


def raw_order(raw: DataFrame, cursor: str, kind: str) -> list[Column]:
    """Order of envelopes of one key: the record's own typed cursor, then time of extraction and raw id."""
    dtype = raw.schema["record"].dataType[cursor].dataType
    return [*cursor_sort_key(F.col(f"record.`{cursor}`"), dtype, kind), F.col("_sync_extracted_at"), F.col("_sync_raw_id")]


def latest_raw(raw: DataFrame, cursor: str, kind: str) -> DataFrame:
    """Winning envelope per primary key, deleted ones included."""
    return latest_per_key(raw, ["_sync_primary_key"], raw_order(raw, cursor, kind))


def version_history(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], hot_rows: int | None = None,
    slices: int | None = None,
) -> DataFrame:
    """Every version of every key with its validity span; the newest is current."""
    start = order[0]
    out = with_frame(
        df, keys, order, before=0, after=1,
        outputs={"valid_to": lambda w: F.lead(F.col(start)).over(w),
                 "__has_next": lambda w: F.lead(F.lit(1)).over(w)},
        hot_rows=hot_rows, slices=slices,
    )
    return out.withColumns(
        {"valid_from": F.col(start), "is_current": F.col("__has_next").isNull()}
    ).drop("__has_next")


def compare_signatures(
    source: DataFrame, destination: DataFrame, keys: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """State of every key: unchanged, changed, new or deleted against the destination."""
    def signed(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys, row_hash(df.schema, columns).alias(name))

    joined = signed(source, "source_signature").join(
        signed(destination, "destination_signature"), list(keys), "full"
    )
    state = (
        F.when(F.col("destination_signature").isNull(), "new")
        .when(F.col("source_signature").isNull(), "deleted")
        .when(F.col("source_signature") == F.col("destination_signature"), "unchanged")
        .otherwise("changed")
    )
    return joined.withColumn("row_state", state)


def table_fingerprint(df: DataFrame, digest: Column) -> DataFrame:
    """Order-free fingerprint of all rows: count, xor and sum of 60 hash bits, and one digest."""
    bits = df.select(hash_bits(digest).alias("bits"))
    folded = bits.agg(
        F.count("*").alias("row_count"),
        F.coalesce(F.bit_xor("bits"), F.lit(0)).alias("xor_bits"),
        F.coalesce(F.sum(F.col("bits").cast("decimal(20,0)")), F.lit(0)).cast("string").alias("sum_bits"),
    )
    text = F.concat_ws(":", F.col("row_count").cast("string"), F.col("xor_bits").cast("string"), "sum_bits")
    return folded.withColumn("fingerprint", F.sha2(text, 256))
