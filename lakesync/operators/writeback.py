"""Write-back: rows become payloads, batches, outcomes and dead letters.

Every step ends in a table.  Sending is left to a ``foreachPartition`` callback
on the payload table (see ``plans.reverse``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from urllib.parse import quote_plus

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from lakesync.functions.text import url_encode_segment
from lakesync.functions.values import comparable_text, json_quote, row_hash
from lakesync.operators.ordered import row_index
from lakesync.operators.schema import first_violation
from lakesync.operators.sync import table_fingerprint
from lakesync.sources.tables import TableStore

DEFAULT_BATCH = 100
DEDUPE_FIELDS = ("email", "domain", "external_id")


def map_fields(df: DataFrame, mappings: Mapping[str, str], plan_id: str | None = None) -> DataFrame:
    """Source columns under their destination names, the rest dropped, missing ones null."""
    columns = [
        (F.col(f"`{src}`") if src in df.columns else F.lit(None).cast("string")).alias(dst)
        for src, dst in mappings.items()
    ]
    if plan_id:
        columns.append(F.lit(plan_id).alias("_sync_reverse_plan_id"))
    return df.select(*columns)


def plan_hash(mapped: DataFrame, settings: Mapping[str, str]) -> DataFrame:
    """Fingerprint of the plan settings and of all mapped rows, in any row order."""
    rows = table_fingerprint(mapped, row_hash(mapped.schema, mapped.columns))
    text = "".join(f"{k}={v};" for k, v in sorted(settings.items()))
    return rows.withColumn("plan_hash", F.sha2(F.concat(F.lit(text), F.col("fingerprint")), 256))


def plan_preview(mapped: DataFrame, order: Sequence[str], action: str, rows: int = 3) -> DataFrame:
    """First rows with the total count and action."""
    total = mapped.agg(F.count("*")).scalar()
    sample = mapped.orderBy(*order).limit(rows)
    return sample.withColumns({"record_count": total, "action": F.lit(action or "upsert")})


def changed_rows(planned: DataFrame, current: DataFrame) -> DataFrame:
    """Rows that differ between the planned and the current mapped table, by row hash.

    Copies are counted before the join, so any number of equal rows is one row of it.
    """
    def counted(df: DataFrame, name: str) -> DataFrame:
        hashed = df.select(row_hash(df.schema, df.columns).alias("row_hash"))
        return hashed.groupBy("row_hash").agg(F.count("*").alias(name))

    joined = counted(planned, "planned_n").join(counted(current, "current_n"), "row_hash", "full").na.fill(0)
    return joined.where(F.col("planned_n") != F.col("current_n")).withColumn(
        "change", F.when(F.col("planned_n") > F.col("current_n"), "removed").otherwise("added")
    )


def plan_status(plans: DataFrame, now: Column) -> DataFrame:
    """Status of every plan at a time: a planned one past its expiry is expired."""
    waiting = F.col("status") == "planned"
    return plans.withColumns(
        {
            "status_now": F.when(waiting & (now > F.col("expires_at")), "expired").otherwise(F.col("status")),
            "can_run": waiting & (now <= F.col("expires_at")) & F.col("token_hash").isNotNull(),
        }
    )


def validate_write(df: DataFrame, record: str, schema: Mapping, index: str) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and rejected rows with their index and first violation."""
    found = first_violation(F.col(record), schema)
    # Exploding the violation works it out once; a filter on it would do so twice.
    rejected = df.select(F.col(index).alias("record_index"), F.explode(F.array_compact(F.array(found))).alias("violation"))
    return df.where(found.isNull()), rejected


def json_payload(df: DataFrame, path_fields: Sequence[str] = (), body_fields: Sequence[str] = ()) -> Column:
    """JSON body: the listed fields, or all fields that are not part of the path."""
    names = [f for f in body_fields if f in df.columns] or [c for c in df.columns if c not in path_fields]
    return F.to_json(F.struct(*(F.col(f"`{n}`") for n in names)))


def form_payload(df: DataFrame, path_fields: Sequence[str] = ()) -> Column:
    """Form body: ``k=v`` sorted by name, percent-encoded, without nulls and empty text."""
    pairs = []
    for name in sorted(c for c in df.columns if c not in path_fields):
        text = comparable_text(F.col(f"`{name}`"), df.schema[name].dataType)
        value = F.replace(url_encode_segment(text), F.lit("%20"), F.lit("+"))
        pairs.append(F.when(text != "", F.concat(F.lit(f"{quote_plus(name)}="), value)))
    return F.array_join(F.array_compact(F.array(*pairs)), "&")


def array_payload(df: DataFrame, field: str) -> Column:
    """One array field as the whole body."""
    return F.to_json(F.col(field))


def dedupe_key(schema: T.StructType) -> Column:
    """Present ones of email, domain and external id as ``k=v`` parts; null when none is."""
    parts = [
        F.concat(F.lit(f"{name}="), comparable_text(F.col(name), schema[name].dataType))
        for name in DEDUPE_FIELDS if name in schema.names
    ]
    if not parts:
        return F.lit(None).cast("string")
    return F.nullif(F.concat_ws("|", *parts), F.lit(""))


def dedupe_actions(df: DataFrame, input_order: str) -> DataFrame:
    """Last row per dedupe key wins; rows without a key all stay (and are not shuffled)."""
    keyed = df.withColumn("__key", dedupe_key(df.schema))
    window = Window.partitionBy("__key").orderBy(F.desc(input_order))
    with_key = keyed.where(F.col("__key").isNotNull())
    last = with_key.withColumn("__n", F.row_number().over(window)).where(F.col("__n") == 1).drop("__n")
    return last.unionByName(keyed.where(F.col("__key").isNull())).drop("__key")


def record_id(schema: T.StructType, columns: Sequence[str], flow: str, step: str) -> Column:
    """SHA-256 over flow, step and all columns in name order as ``name=<json>;``."""
    parts = [F.lit(f"{flow}/{step}:")]
    for name in sorted(columns):
        dtype = schema[name].dataType
        text = comparable_text(F.col(f"`{name}`"), dtype)
        if isinstance(dtype, (T.StringType, T.TimestampNTZType, T.TimestampType, T.DateType)):
            text = json_quote(text)
        parts += [F.lit(f"{name}="), F.coalesce(text, F.lit("null")), F.lit(";")]
    return F.sha2(F.concat(*parts), 256)


def skip_sent(df: DataFrame, identity: DataFrame, record: str = "record_id") -> DataFrame:
    return df.join(identity.select(record), record, "left_anti")


def assign_batches(df: DataFrame, order: Sequence[str], size: int = DEFAULT_BATCH) -> DataFrame:
    """Batch number and position by row index over the whole table."""
    indexed = row_index(df, order)
    return indexed.withColumns(
        {"batch_no": F.floor(F.col("row_index") / size).cast("bigint"),
         "batch_pos": (F.col("row_index") % size).cast("bigint")}
    )


def delivery_outcomes(sent: DataFrame, responses: DataFrame, record: str = "record_id") -> DataFrame:
    """Outcome of every sent row.

    ``responses`` holds ``(record_id, failed, external_id)``.  Only a listed
    failure counts as one; a row without any answer has succeeded.
    """
    answers = responses.groupBy(record).agg(
        F.bool_or("failed").alias("failed"), F.max("external_id").alias("external_id")
    )
    failed = F.coalesce(F.col("failed"), F.lit(False))
    joined = sent.join(answers, record, "left")
    return joined.withColumns(
        {
            "outcome": F.when(failed, "dead_letter").otherwise("succeeded"),
            "mapped_id": F.when(~failed, F.coalesce("external_id", record)),
        }
    ).drop("failed", "external_id")


def with_batch_failures(outcomes: DataFrame, failures: DataFrame, batch: str = "batch_no") -> DataFrame:
    """Outcomes after batches failed as a whole: each of their rows is a dead letter with the batch's error.

    ``failures`` holds ``(batch, error, retries)`` of batches that no retry helped; its rows count ``retries + 1`` attempts.
    """
    lost = failures.groupBy(batch).agg(F.max("error").alias("batch_error"), (F.max("retries") + 1).alias("batch_attempts"))
    failed = F.col("batch_error").isNotNull()
    return outcomes.join(lost, batch, "left").withColumns(
        {"outcome": F.when(failed, "dead_letter").otherwise(F.col("outcome")),
         "mapped_id": F.when(~failed, F.col("mapped_id"))}
    )


def dead_letters(outcomes: DataFrame, fields: Sequence[str], error: str | Column, attempts: int | Column,
                 record: str = "record_id") -> DataFrame:
    """Failed rows with id, error, attempts and a record whose values are blotted out; error and attempts may be columns."""
    blotted = F.to_json(F.struct(*(F.lit("[REDACTED]").alias(f) for f in fields)))
    return outcomes.where(F.col("outcome") == "dead_letter").select(
        record, F.lit(error).alias("error"), F.lit(attempts).alias("attempts"), blotted.alias("record")
    )


def keep_identity(store: TableStore, table: str, run_id: str, outcomes: DataFrame, record: str = "record_id") -> int:
    """Add the ids of the rows that arrived to a stored map, which later runs read with ``known_identity``."""
    arrived = outcomes.where(F.col("outcome") == "succeeded").select(record, "mapped_id")
    return store.append(table, run_id, arrived)


def known_identity(store: TableStore, table: str) -> DataFrame:
    """All ids in a stored map; empty before the first run."""
    if table not in store.names():
        return store.spark.createDataFrame([], "record_id string, mapped_id string")
    return store.read(table)


def keep_dead_letters(store: TableStore, table: str, flow: str, step: str, run_id: str, letters: DataFrame) -> int:
    """Append dead letters, stamped with flow, step and run."""
    stamped = letters.withColumns({"flow": F.lit(flow), "step": F.lit(step), "run_id": F.lit(run_id)})
    return store.append(table, f"{flow}/{step}/{run_id}".replace("/", "-"), stamped)


def count_missing_as_written(responses: DataFrame, kind: str, allowed: Sequence[int]) -> DataFrame:
    """A delete answered with an allowed status counts as written."""
    good = F.col("status").between(200, 299)
    if kind == "delete" and allowed:
        good = good | F.col("status").isin(*allowed)
    return responses.withColumn("written", good)


def classify_errors(responses: DataFrame, rules: Sequence[tuple[int, str | None, str, str]]) -> DataFrame:
    """Class and hint of the first rule ``(status, text in the body, class, hint)`` that matches."""
    chosen = F.lit(None).cast("struct<error_class:string,hint:string>")
    for status, needle, name, hint in reversed(rules):
        matches = F.col("status") == status
        if needle:
            matches = matches & F.contains(F.col("body"), F.lit(needle))
        answer = F.struct(F.lit(name).alias("error_class"), F.lit(hint).alias("hint"))
        chosen = F.when(matches, answer).otherwise(chosen)
    return responses.withColumns(
        {"error_class": F.coalesce(chosen["error_class"], F.lit("")), "hint": F.coalesce(chosen["hint"], F.lit(""))}
    )
