"""Projection, filters, computed columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F, types as T

from lakesync.operators import shape
from lakesync.queries.extraction import text
from lakesync.queries.registry import query, table


@query("project_schema", """
    SELECT c_custkey, c_name, CAST(NULL AS VARCHAR) AS c_phone FROM customer
""")
def project_schema(spark, sf_dir):
    declared = T.StructType.fromDDL("c_custkey bigint, c_name string, c_phone string")
    return shape.project(table(spark, sf_dir, "customer"), declared)


def _sparse_events(spark, sf_dir):
    """Events with some values and cursors missing."""
    key = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        "event_id", "event_type", F.when(key % 4 != 0, F.col("value")).alias("value"),
        F.when(key % 6 != 0, F.col("ts")).alias("ts"), (key % 2 == 0).alias("even"), "user_id",
    )


@query("filter_field_absent", "SELECT event_id, event_type FROM events WHERE event_id % 4 = 0")
def filter_field_absent(spark, sf_dir):
    return shape.where_absent(_sparse_events(spark, sf_dir), "value").select("event_id", "event_type")


@query("filter_field_equals", """
    SELECT event_id, user_id FROM events WHERE event_type = 'click' AND event_id % 2 = 0 AND user_id = 7
    UNION ALL
    SELECT event_id, user_id FROM events WHERE event_id % 4 = 0 AND event_type = 'view'
""")
def filter_field_equals(spark, sf_dir):
    events = _sparse_events(spark, sf_dir)
    some = shape.where_equals(events, {"event_type": "click", "even": True, "user_id": 7})
    unset = shape.where_equals(events, {"value": None, "event_type": "view"})
    return some.unionByName(unset).select("event_id", "user_id")


@query("filter_after_cursor", """
    SELECT event_id FROM events WHERE event_id % 6 = 0 OR ts > TIMESTAMP '2024-01-20 12:00:00'
""")
def filter_after_cursor(spark, sf_dir):
    kept = shape.where_after_cursor(_sparse_events(spark, sf_dir), "ts", "2024-01-20T12:00:00.000000Z")
    return kept.select("event_id")


def _nested_orders(spark, sf_dir):
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.struct(F.col("o_custkey").alias("key"), F.when(key % 3 == 0, "").otherwise(F.col("o_orderstatus")).alias("state"),
                 F.col("o_orderpriority").alias("priority")).alias("customer"),
        F.array(F.col("o_orderstatus"), F.col("o_orderpriority"), F.lit(None)).alias("tags"),
        F.col("o_totalprice").alias("price"),
        F.when(key % 5 != 0, text("https://x.example/orders/", key, "/")).alias("uri"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ordered_at"),
    )


@query("computed_columns", """
    SELECT o_orderkey AS id, o_custkey AS customer_key, 3 AS tag_count, o_totalprice AS price,
           CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE o_orderstatus END AS state,
           'acme/' || o_custkey AS marker,
           CASE WHEN o_orderkey % 5 <> 0 THEN 'see https://x.example/orders/' || o_orderkey || '/' END AS note,
           'fixed' AS fixed
    FROM orders
""")
def computed_columns(spark, sf_dir):
    templates = {
        "customer_key": "{{ record.customer.key }}", "tag_count": "{{ record.tags | length }}",
        "state": "{{ coalesce record.customer.state record.customer.priority }}",
        "marker": "{{ config.owner }}/{{ record.customer.key }}", "note": "see {{ record.uri }}",
        "absent": "{{ record.customer.email }}", "fixed": "fixed",
    }
    declared = T.StructType.fromDDL("id bigint, price double")
    return shape.computed_columns(_nested_orders(spark, sf_dir), templates, {"owner": "acme"}, declared)


@query("template_filters", """
    SELECT o_orderkey AS id, url_encode(o_orderpriority) AS encoded,
           CAST(CAST(epoch(o_orderdate) AS BIGINT) AS VARCHAR) AS seconds,
           to_base64(encode(o_orderpriority)) AS coded,
           CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderkey AS VARCHAR) END AS segment,
           o_orderstatus || ';' || o_orderpriority || ';' AS joined, '3' AS n,
           CASE WHEN o_orderkey % 5 <> 0 THEN 'uri' END AS sort_by,
           to_base64(encode(url_encode(o_orderpriority))) AS chained
    FROM orders
""")
def template_filters(spark, sf_dir):
    templates = {
        "encoded": "{{ record.customer.priority | urlencode }}", "seconds": "{{ record.ordered_at | unix_seconds }}",
        "coded": "{{ record.customer.priority | base64 }}", "segment": "{{ record.uri | last_path_segment }}",
        "joined": "{{ record.tags | join:; }}", "n": "{{ record.tags | length }}{{ config.none }}",
        "sort_by": "{{ record.uri | const:uri }}", "chained": "{{ record.customer.priority | urlencode | base64 }}",
    }
    declared = T.StructType.fromDDL("id bigint")
    return shape.computed_columns(_nested_orders(spark, sf_dir), templates, {"none": ""}, declared)


@query("when_condition", """
    SELECT o_orderkey AS id, 'equals' AS rule FROM orders WHERE o_custkey = 7
    UNION ALL
    SELECT o_orderkey, 'listed' FROM orders WHERE o_orderstatus IN ('P', 'F') AND o_orderkey % 3 <> 0 OR o_orderkey % 3 = 0
    UNION ALL
    SELECT o_orderkey, 'set' FROM orders WHERE o_orderkey % 5 <> 0
""")
def when_condition(spark, sf_dir):
    orders = _nested_orders(spark, sf_dir)
    rules = {
        "equals": "{{ record.customer.key == '7' }}", "listed": "record.customer.state in ['P', 'F', '']",
        "set": "{{ record.uri }}",
    }
    parts = [shape.where_condition(orders, c).select("id", F.lit(r).alias("rule")) for r, c in rules.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_MIXED_TIME = """
    SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(CAST(floor(epoch(ts)) AS BIGINT) AS VARCHAR)
                                       WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ')
                                       WHEN 2 THEN strftime(ts, '%Y-%m-%d') ELSE 'next week' END AS t,
           CASE event_id % 4 WHEN 2 THEN date_trunc('day', ts) WHEN 3 THEN NULL ELSE date_trunc('second', ts) END AS m
    FROM events
"""


@query("normalize_time_text", f"""
    SELECT event_id, t AS rfc3339, CAST(CAST(epoch(m) AS BIGINT) AS VARCHAR) AS unix_seconds,
           strftime(m, '%Y-%m-%d') AS date, '>=' || strftime(m, '%Y-%m-%dT%H:%M:%SZ') AS after_range,
           CASE WHEN event_id % 4 IN (1, 2) THEN strftime(m, '%Y-%m-%d %H:%M:%S') ELSE t END AS datetime,
           CASE WHEN m IS NULL THEN 'invalid time value: ' || t END AS error
    FROM ({_MIXED_TIME})
""")
def normalize_time_text(spark, sf_dir):
    key = F.col("event_id")
    mixed = (
        F.when(key % 4 == 0, F.unix_seconds(F.col("ts").cast("timestamp")).cast("string"))
        .when(key % 4 == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(key % 4 == 2, F.date_format("ts", "yyyy-MM-dd")).otherwise("next week")
    )
    rows = table(spark, sf_dir, "events").select("event_id", mixed.alias("t"))
    forms = ["rfc3339", "unix_seconds", "date", "after_range", "datetime"]
    for form in forms:
        rows = shape.normalize_time(rows, "t", form, form)
    return rows.select("event_id", *forms, F.col("date_error").alias("error"))


@query("fields_subset", "SELECT p_brand, p_partkey FROM part")
def fields_subset(spark, sf_dir):
    return shape.fields_subset(table(spark, sf_dir, "part"), ["p_brand", "p_color", "p_partkey"])


@query("record_hook_map", """
    SELECT doc_id, upper(lang) AS lang, n_chars * 2 AS size FROM documents WHERE doc_id % 3 <> 0
""")
def record_hook_map(spark, sf_dir):
    def hook(rows: pd.DataFrame) -> pd.DataFrame:
        kept = rows[rows["doc_id"] % 3 != 0]
        return pd.DataFrame({"doc_id": kept["doc_id"], "lang": kept["lang"].str.upper(), "size": kept["n_chars"] * 2})

    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return shape.map_rows(docs, hook, "doc_id bigint, lang string, size bigint")


@query("pg_text_decode", """
    SELECT event_id, CASE WHEN event_id % 4 = 0 THEN event_id % 8 = 0 END AS bool_value,
           CASE WHEN event_id % 4 = 1 AND event_id % 3 <> 0 THEN user_id END AS int_value,
           CASE WHEN event_id % 4 = 2 THEN value END AS float_value,
           CASE WHEN event_id % 4 = 3 THEN event_type WHEN event_id % 4 = 1 AND event_id % 3 = 0 THEN 'not a number' END AS text_value
    FROM events
""")
def pg_text_decode(spark, sf_dir):
    key = F.col("event_id")
    type_id = F.when(key % 4 == 0, 16).when(key % 4 == 1, 23).when(key % 4 == 2, 701).otherwise(25)
    raw = (
        F.when(key % 4 == 0, F.when(key % 8 == 0, "t").otherwise("f"))
        .when(key % 4 == 1, F.when(key % 3 == 0, "not a number").otherwise(F.col("user_id").cast("string")))
        .when(key % 4 == 2, F.col("value").cast("string")).otherwise(F.col("event_type"))
    )
    rows = table(spark, sf_dir, "events").select("event_id", type_id.alias("type_id"), raw.alias("raw"))
    read = shape.decode_text(F.col("raw"), F.col("type_id"))
    return rows.select("event_id", *(c.alias(n) for n, c in read.items()))
