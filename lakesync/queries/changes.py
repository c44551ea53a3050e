"""Change data capture: events read as a log of changes.

``error`` rows are deletes, ``signup`` rows inserts, the rest updates; an
update with ``event_id % 4 = 0`` does not carry its value (unchanged).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lakesync.operators import cdc
from lakesync.queries.registry import query, table

INT8, TEXT, FLOAT8 = 20, 25, 701


def _op() -> Column:
    kind = F.col("event_type")
    return F.when(kind == "error", "delete").when(kind == "signup", "insert").otherwise("update")


def _lsn(position: Column) -> Column:
    """Log position text: high and low half in hex."""
    return F.concat(F.hex(F.shiftright(position, 8)), F.lit("/"), F.hex(position.bitwiseAND(F.lit(255)) * 16777216))


def change_events(spark, sf_dir) -> DataFrame:
    events = table(spark, sf_dir, "events")
    op, key = _op(), F.col("event_id")
    sent = (op != "update") | (key % 4 != 0)
    return events.select(
        "user_id", cdc.lsn_position(_lsn(key)).alias("position"), op.alias("op"),
        F.when(sent, F.col("value")).alias("value"), sent.alias("value_set"),
        F.when(key % 10 != 0, F.col("props")).alias("props"), F.lit(True).alias("props_set"),
    )


_POSITION = "((event_id >> 8) << 32) + (event_id & 255) * 16777216"


def relations(spark, sf_dir) -> DataFrame:
    """Relation definitions: a first one per relation, and a new one with every signup."""
    events = table(spark, sf_dir, "events")
    relation = (F.col("user_id") % 5).alias("relation_id")
    first = events.select(relation).distinct().select("relation_id", F.lit(-1).cast("bigint").alias("position"))
    later = events.where(F.col("event_type") == "signup").select(relation, F.col("event_id").alias("position"))
    return first.unionByName(later).withColumn("version", F.col("position"))


@query("cdc_bind_relation", """
    SELECT e.event_id, e.user_id % 5 AS relation_id, coalesce(max(s.event_id), -1) AS version
    FROM (SELECT event_id, user_id FROM events WHERE event_type <> 'signup') e
    ASOF LEFT JOIN (SELECT event_id, user_id % 5 AS r FROM events WHERE event_type = 'signup') s
    ON e.user_id % 5 = s.r AND e.event_id >= s.event_id GROUP BY ALL
""")
def cdc_bind_relation(spark, sf_dir):
    changes = table(spark, sf_dir, "events").where(F.col("event_type") != "signup").select(
        "event_id", (F.col("user_id") % 5).alias("relation_id"), F.col("event_id").alias("position")
    )
    bound = cdc.bind_relations(changes, relations(spark, sf_dir), ["version"])
    return bound.select("event_id", "relation_id", "version")


def _bytes_hex(text: Column) -> Column:
    """A text cell: kind, length, bytes; null is its own kind."""
    size = F.lpad(F.hex(F.octet_length(text).cast("bigint")), 8, "0")
    return F.coalesce(F.concat(F.lit("74"), size, F.hex(F.encode(text, "UTF-8"))), F.lit("6E"))


def messages(spark, sf_dir) -> DataFrame:
    """Binary change messages, built in Spark from the events."""
    events, key = table(spark, sf_dir, "events").withColumn("op", _op()), F.col("event_id")
    op, user = F.col("op"), F.col("user_id").cast("string")
    unchanged = (op == "update") & (key % 4 == 0)
    cells = events.select(
        "event_id", "user_id", "op", _bytes_hex(user).alias("user"), _bytes_hex(F.col("event_type")).alias("kind"),
        F.when(unchanged, F.lit("75")).otherwise(_bytes_hex(F.col("value").cast("string"))).alias("value"),
        _bytes_hex(F.when(key % 10 != 0, F.col("props"))).alias("props"),
    )
    old_key = F.when((op == "update") & (key % 3 == 0), F.concat(F.lit("4B0001"), "user")).otherwise("")
    tag = F.when(op == "delete", "44").when(op == "insert", "49").otherwise("55")
    marker = F.when(op == "delete", "4F").otherwise("4E")
    relation = F.lpad(F.hex(F.col("user_id") % 5), 8, "0")
    body = F.concat(tag, relation, old_key, marker, F.lit("0004"), "user", "kind", "value", "props")
    changes = cells.select(key.alias("position"), _lsn(key).alias("lsn"), F.unhex(body).alias("message"))
    marks = events.where(F.col("event_type") == "signup").select(
        key.alias("position"), _lsn(key).alias("lsn"), F.unhex(F.lit("42")).alias("message")
    )
    return changes.unionByName(marks)


_SENT = "event_type IN ('error', 'signup') OR event_id % 4 <> 0"


@query("cdc_events", f"""
    SELECT event_id AS position, CASE event_type WHEN 'error' THEN 'delete' WHEN 'signup' THEN 'insert' ELSE 'update' END AS op,
           user_id, event_type, CASE WHEN {_SENT} THEN value END AS value, {_SENT} AS value_set,
           CASE WHEN event_id % 10 <> 0 THEN props END AS props, true AS props_set
    FROM events
""")
def cdc_events(spark, sf_dir):
    columns = {"user_id": INT8, "event_type": TEXT, "value": FLOAT8, "props": TEXT}
    listed = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(t).alias("type_id")) for n, t in columns.items()))
    known = relations(spark, sf_dir).withColumn("columns", listed)
    decoded = cdc.decode_messages(messages(spark, sf_dir), "message", ["position", "lsn"])
    bound = cdc.bind_relations(decoded, known, ["columns"])
    kinds = {"user_id": "int", "event_type": "text", "value": "float", "props": "text"}
    events = cdc.cdc_events(bound, kinds, ["position", "op"])
    return events.drop("user_id_set", "event_type_set")


_APPLIED = f"""
    WITH e AS (SELECT *, {_SENT} AS sent, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS life FROM events),
         l AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)
    SELECT l.user_id, v.value, CASE WHEN l.event_id % 10 <> 0 THEN l.props END AS props
    FROM l LEFT JOIN (SELECT user_id, life, arg_max(value, event_id) AS value FROM e WHERE sent AND event_type <> 'error' GROUP BY user_id, life) v
    ON l.user_id = v.user_id AND l.life = v.life
    WHERE l.event_type <> 'error'
"""


@query("cdc_apply", _APPLIED)
def cdc_apply(spark, sf_dir):
    events = change_events(spark, sf_dir)
    return cdc.apply_changes(events, ["user_id"], ["value", "props"], "position").select("user_id", "value", "props")


@query("cdc_positions", f"SELECT event_id, {_POSITION} AS position FROM events")
def cdc_positions(spark, sf_dir):
    key = F.col("event_id")
    return table(spark, sf_dir, "events").select(key, cdc.lsn_position(_lsn(key)).alias("position"))
