"""Schema inference, validation and drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lakesync.operators import schema
from lakesync.queries.extraction import text
from lakesync.queries.registry import query, table

# Fields of the JSON records below, as SQL pieces (null = field left out).
_RECORD = """
    SELECT event_id, event_type,
           event_id % 11 <> 0 AS has_id, event_id % 13 = 0 AS has_extra, event_id % 7 = 0 AS text_amount,
           event_id % 5 = 0 AS bad_tag, user_id, value
    FROM events
"""


def event_records(spark, sf_dir) -> DataFrame:
    """Events as JSON text; some lack fields, carry others, or have values of the wrong type."""
    key = F.col("event_id")
    amount = F.when(key % 7 == 0, text('"', F.col("value"), '"')).when(key % 9 == 0, "null").otherwise(F.col("value").cast("string"))
    fields = F.array_compact(
        F.array(
            F.when(key % 11 != 0, text('"id":', key)), text('"type":"', F.col("event_type"), '"'),
            text('"amount":', amount), text('"code":"u', F.col("user_id"), '"'),
            text('"at":"', F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), '"'),
            text('"tags":["a",', F.when(key % 5 == 0, "2").otherwise('"b"'), "]"),
            text('"meta":', F.col("props")), F.when(key % 13 == 0, '"extra":1.0'),
        )
    )
    body = text("{", F.array_join(fields, ","), "}")
    return table(spark, sf_dir, "events").select("event_id", "event_type", F.parse_json(body).alias("record"))


_TYPES = """
    SELECT event_id, event_type, field, type FROM (
        SELECT event_id, event_type, unnest(['id', 'type', 'amount', 'code', 'at', 'tags', 'meta', 'extra']) AS field,
               unnest([CASE WHEN event_id % 11 <> 0 THEN 'integer' END, 'string',
                       CASE WHEN event_id % 7 = 0 THEN 'string' WHEN event_id % 9 = 0 THEN 'null'
                            WHEN value = floor(value) THEN 'integer' ELSE 'number' END,
                       'string', 'timestamp', 'array', 'object', CASE WHEN event_id % 13 = 0 THEN 'integer' END]) AS type
        FROM events) WHERE type IS NOT NULL
"""
_INFERRED = f"""
    SELECT event_type, field, coalesce(arg_min(type, event_id) FILTER (type <> 'null'), 'null') AS type
    FROM ({_TYPES}) GROUP BY event_type, field
"""


@query("infer_types", f"""
    WITH t AS ({_TYPES}), c AS (SELECT field, type, count(*) AS n FROM t GROUP BY field, type)
    SELECT field, coalesce(arg_min(type, event_id) FILTER (type <> 'null'), 'null') AS type,
           count(DISTINCT type) FILTER (type <> 'null') AS type_count,
           (SELECT type FROM c WHERE c.field = t.field AND type <> 'null' ORDER BY n DESC, type DESC LIMIT 1) AS majority_type
    FROM t GROUP BY field
""")
def infer_types(spark, sf_dir):
    return schema.infer_types(event_records(spark, sf_dir), "record", "event_id")


SCHEMA = {
    "type": "object", "required": ["id", "type"], "additionalProperties": False, "minProperties": 3,
    "properties": {
        "id": {"type": "integer"}, "type": {"enum": ["view", "click", "purchase", "signup"]},
        "amount": {"type": ["number", "null"]}, "code": {"type": "string", "pattern": "^u[0-9]{1,2}$"},
        "at": {"type": "string"}, "tags": {"type": "array", "items": {"type": "string"}},
        "meta": {"type": "object", "properties": {"k": {"type": "integer", "enum": list(range(0, 95))}}},
    },
}


@query("validate_rows_against_schema", f"""
    SELECT event_id, CASE
        WHEN NOT has_id THEN '/id: required property missing'
        WHEN has_extra THEN '/extra: additional property not allowed'
        WHEN text_amount THEN '/amount: value does not match type [''number'', ''null'']'
        WHEN user_id > 99 THEN '/code: value does not match pattern'
        WHEN k > 94 THEN '/meta/k: value not in enum'
        WHEN bad_tag THEN '/tags/1: value does not match type [''string'']'
        WHEN event_type = 'error' THEN '/type: value not in enum' END AS violation
    FROM ({_RECORD}) JOIN (SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events) USING (event_id)
""")
def validate_rows_against_schema(spark, sf_dir):
    return schema.validate_rows(event_records(spark, sf_dir), "record", SCHEMA).select("event_id", "violation")


@query("schema_drift", f"""
    WITH snap AS (SELECT event_type, field, type FROM ({_INFERRED}) WHERE NOT (event_type = 'view' AND field = 'code')),
         live AS (SELECT event_type, field, CASE WHEN field = 'id' AND event_type = 'click' THEN 'string' ELSE type END AS type
                  FROM ({_INFERRED}) WHERE NOT (event_type = 'error' AND field = 'tags'))
    SELECT event_type, field, s.type AS snapshot_type, l.type AS live_type,
           CASE WHEN l.type IS NULL THEN 'removed' WHEN s.type IS NULL THEN 'added'
                WHEN s.type <> l.type THEN 'retyped' ELSE 'same' END AS change,
           l.type IS NULL OR (s.type IS NOT NULL AND s.type <> l.type) AS breaking
    FROM snap s FULL JOIN live l USING (event_type, field)
""")
def schema_drift(spark, sf_dir):
    inferred = schema.infer_types(event_records(spark, sf_dir), "record", "event_id", by=["event_type"])
    inferred = inferred.select("event_type", "field", "type")
    kind, field = F.col("event_type"), F.col("field")
    snapshot = inferred.where(~((kind == "view") & (field == "code")))
    retyped = F.when((field == "id") & (kind == "click"), "string").otherwise(F.col("type"))
    live = inferred.where(~((kind == "error") & (field == "tags"))).withColumn("type", retyped)
    return schema.schema_drift(snapshot, live, by=["event_type"])


def _declared(inferred: DataFrame) -> DataFrame:
    """Key and cursor fields each stream declares; some declare fields nobody has seen."""
    streams = inferred.select(F.col("event_type").alias("stream")).distinct()
    wrong = F.col("stream").isin("error", "view")
    return streams.select(
        "stream",
        F.inline(
            F.array(
                F.struct(F.lit("primary_key").alias("role"), F.when(wrong, "uuid").otherwise("id").alias("field")),
                F.struct(F.lit("cursor").alias("role"), F.when(F.col("stream") == "error", "seen_at").otherwise("at").alias("field")),
            )
        ),
    )


@query("key_fields_declared", """
    SELECT * FROM (SELECT DISTINCT event_type AS stream, unnest(['primary_key', 'cursor']) AS role,
                   unnest([CASE WHEN event_type IN ('error', 'view') THEN 'uuid' ELSE 'id' END,
                           CASE WHEN event_type = 'error' THEN 'seen_at' ELSE 'at' END]) AS field FROM events)
    WHERE field IN ('uuid', 'seen_at')
""")
def key_fields_declared(spark, sf_dir):
    inferred = schema.infer_types(event_records(spark, sf_dir), "record", "event_id", by=["event_type"])
    catalog = inferred.select(F.col("event_type").alias("stream"), "field")
    return schema.undeclared_fields(_declared(inferred), catalog)


@query("sync_modes_derived", """
    WITH s AS (SELECT DISTINCT event_type AS stream, event_type NOT IN ('error', 'view') AS k, event_type <> 'error' AS c FROM events)
    SELECT stream, m AS sync_mode FROM s, (VALUES ('full_refresh_append', false, false), ('full_refresh_overwrite', false, false),
        ('full_refresh_overwrite_deduped', true, false), ('incremental_append', false, true),
        ('incremental_append_deduped', true, true)) v(m, need_k, need_c)
    WHERE (k OR NOT need_k) AND (c OR NOT need_c)
""")
def sync_modes_derived(spark, sf_dir):
    inferred = schema.infer_types(event_records(spark, sf_dir), "record", "event_id", by=["event_type"])
    catalog = inferred.select(F.col("event_type").alias("stream"), "field")
    valid = _declared(inferred).join(catalog, ["stream", "field"], "left_semi")
    streams = catalog.select("stream").distinct().join(valid, "stream", "left").groupBy("stream").agg(
        F.coalesce(F.bool_or(F.col("role") == "primary_key"), F.lit(False)).alias("has_key"),
        F.coalesce(F.bool_or(F.col("role") == "cursor"), F.lit(False)).alias("has_cursor"),
    )
    return schema.derived_sync_modes(streams).select("stream", "sync_mode")
