"""Sources, sinks and generators over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakesync.functions.values import iso_micros
from lakesync.operators.schema import catalog_of, verified_keys
from lakesync.operators.sync import StreamSpec, enrich, raw_envelope
from lakesync.queries.registry import query, table
from lakesync.sources import generators
from lakesync.sources.readers import list_folder, read_csv, read_jsonl, read_landing_dir, read_limited, snapshot
from lakesync.sources.tables import TableStore, stamp_outbox, to_ndjson
from lakesync.workspace import fresh_dir

RUN_AT = "2024-02-01T00:00:00.000000Z"
ISO = "%Y-%m-%dT%H:%M:%S.%fZ"


@query("src_jsonl", f"""
    SELECT event_id, strftime(ts, '{ISO}') AS ts, user_id, event_type, value, props FROM events
""")
def src_jsonl(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("ts", iso_micros(F.col("ts")))
    path = fresh_dir(spark, "jsonl")
    events.write.json(path)
    return read_jsonl(spark, path, events.schema)


@query("src_jsonl_schemaless", """
    SELECT event_id, event_type, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events
""")
def src_jsonl_schemaless(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        "event_id", "event_type", "value", F.from_json("props", "k bigint").alias("props")
    )
    path = fresh_dir(spark, "jsonl")
    events.write.json(path)
    record = F.col("record")
    return read_jsonl(spark, path).select(
        F.variant_get(record, "$.event_id", "bigint").alias("event_id"),
        F.variant_get(record, "$.event_type", "string").alias("event_type"),
        F.variant_get(record, "$.value", "double").alias("value"),
        F.variant_get(record, "$.props.k", "bigint").alias("k"),
    )


@query("src_csv", """
    SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, source, text FROM documents
""")
def src_csv(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string"), "lang", "source", "text")
    path = fresh_dir(spark, "csv")
    docs.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False
    ).csv(path)
    return read_csv(spark, path, docs.columns)


@query("src_landing_dir", """
    SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment,
           CAST(c_nationkey AS VARCHAR) AS c_nationkey
    FROM customer
""")
def src_landing_dir(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    path = fresh_dir(spark, "landing")
    odd = F.col("c_custkey") % 2 == 1
    customers.where(odd).write.option("header", True).csv(path)
    customers.where(~odd).write.mode("append").json(path)
    return read_landing_dir(spark, path, customers.columns)


@query("table_scan_limit", f"""
    SELECT event_id, strftime(ts, '{ISO}') AS ts, event_type FROM events ORDER BY event_id LIMIT 100
""")
def table_scan_limit(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", iso_micros(F.col("ts")).alias("ts"), "event_type")
    return read_limited(events, 100, ["event_id"])


@query("sink_append", """
    SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders
    UNION ALL
    SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderstatus = 'O'
""")
def sink_append(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    store = TableStore(spark, fresh_dir(spark, "store"))
    store.append("orders", "run1", orders)
    store.append("orders", "run2", orders.where(F.col("o_orderstatus") == "O"))
    return store.read("orders")


@query("sink_overwrite", """
    SELECT o_orderkey, o_custkey, o_totalprice * 2 AS o_totalprice FROM orders
""")
def sink_overwrite(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    store = TableStore(spark, fresh_dir(spark, "store"))
    store.overwrite("orders", "run1", orders)
    # The table is read while its next state is written.
    doubled = store.read("orders").withColumn("o_totalprice", F.col("o_totalprice") * 2)
    store.overwrite("orders", "run2", doubled)
    return store.read("orders")


@query("sink_outbox", f"""
    SELECT s_suppkey, s_name, 'create' AS _outbox_action, '{RUN_AT}' AS _outbox_written_at FROM supplier
    UNION ALL
    SELECT c_custkey, c_name, 'upsert', '{RUN_AT}' FROM customer
""")
def sink_outbox(spark, sf_dir):
    store = TableStore(spark, fresh_dir(spark, "store"))
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("s_suppkey"), F.col("c_name").alias("s_name")
    )
    store.append("outbox", "run1", stamp_outbox(suppliers, "create", RUN_AT))
    store.append("outbox", "run2", stamp_outbox(customers, "upsert", RUN_AT))
    return store.read("outbox")


@query("gen_users", """
    SELECT printf('user_%03d', n) AS id, printf('User %03d', n) AS name,
           printf('user%03d@example.com', n) AS email,
           printf('2026-01-%02dT00:00:00Z', (i - 1) % 28 + 1) AS updated_at
    FROM (SELECT c_custkey + 1 AS i, c_custkey + 8 AS n FROM customer)
""")
def gen_users(spark, sf_dir):
    indexed = table(spark, sf_dir, "customer").select((F.col("c_custkey") + 1).alias("i"))
    return generators.users(indexed, seed=7)


@query("gen_purchases", """
    SELECT printf('purchase_%03d', n) AS id, printf('user_%03d', n) AS user_id,
           printf('product_%03d', i % 10 + 1) AS product_id,
           CAST(i % 10 + 1 AS DOUBLE) * CAST(9.99 AS DOUBLE) AS amount,
           printf('2026-01-%02dT00:00:00Z', (i - 1) % 28 + 1) AS updated_at
    FROM (SELECT o_orderkey + 1 AS i, o_orderkey + 8 AS n FROM orders)
""")
def gen_purchases(spark, sf_dir):
    indexed = table(spark, sf_dir, "orders").select((F.col("o_orderkey") + 1).alias("i"))
    return generators.purchases(indexed, seed=7)


@query("gen_products", """
    SELECT printf('product_%03d', p) AS id, printf('SKU-%03d', p) AS sku, printf('Product %03d', p) AS name,
           p * CAST(4.25 AS DOUBLE) AS price, count(*) AS purchases
    FROM (SELECT (o_orderkey + 1) % 10 + 1 AS p FROM orders) GROUP BY p
""")
def gen_products(spark, sf_dir):
    indexed = table(spark, sf_dir, "orders").select((F.col("o_orderkey") + 1).alias("i"))
    sold = generators.purchases(indexed).groupBy(F.col("product_id").alias("id")).agg(F.count("*").alias("purchases"))
    return generators.products(spark).join(sold, "id")


@query("gen_sync_bench", """
    SELECT printf('rec_%06d', i) AS id, printf('Record %06d', i) AS name,
           strftime(TIMESTAMP '2026-01-01' + to_seconds(i), '%Y-%m-%dT%H:%M:%SZ') AS updated_at
    FROM (SELECT o_orderkey AS i FROM orders)
""")
def gen_sync_bench(spark, sf_dir):
    return generators.sync_bench_rows(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("i")))


@query("jdbc_snapshot", f"""
    SELECT o_orderkey, o_custkey, o_totalprice, strftime(o_orderdate, '{ISO}') AS o_orderdate
    FROM orders WHERE o_orderdate > TIMESTAMP '1999-01-16'
""")
def jdbc_snapshot(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    rows = snapshot(orders, "o_orderdate", "1999-01-16T00:00:00.000000Z", tie=["o_orderkey"])
    return rows.select("o_orderkey", "o_custkey", "o_totalprice", iso_micros(F.col("o_orderdate")).alias("o_orderdate"))


CATALOG = {
    "nation": ["n_nationkey"], "customer": ["c_custkey"], "orders": ["o_orderkey"], "events": ["event_id"],
    "documents": ["doc_id"], "conversations": ["conv_id", "turn"], "lineitem": ["l_orderkey"],
    "embeddings": ["vec_id"],
}


LISTED = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
    "benchmark", "labels", "conversations",
)


def _catalog_sql() -> str:
    parts = [f"""
            SELECT '{name}' AS table_name, column_name, column_type,
                   CAST(row_number() OVER () AS INTEGER) AS ordinal FROM (DESCRIBE {name})""" for name in LISTED]
    return f"""
        SELECT table_name, column_name, ordinal,
               CASE WHEN column_type IN ('INTEGER', 'BIGINT') THEN 'integer'
                    WHEN column_type = 'DOUBLE' THEN 'number'
                    WHEN column_type LIKE 'TIMESTAMP%' THEN 'timestamp'
                    WHEN column_type LIKE '%[]' THEN 'array' ELSE 'string' END AS type,
               (table_name, column_name) IN (('events', 'ts'), ('orders', 'o_orderdate')) AS is_cursor
        FROM ({' UNION ALL '.join(parts)})"""


@query("catalog_discover", _catalog_sql())
def catalog_discover(spark, sf_dir):
    """All tables of the folder by their schemas; no rows are read."""
    return catalog_of(spark, list_folder(spark, sf_dir), cursors={"events": "ts", "orders": "o_orderdate"})


def _keys_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, '{key}' AS column_name WHERE (SELECT max(n) = 1 FROM (SELECT count(*) AS n FROM {name} GROUP BY {', '.join(keys)}))"
        for name, keys in CATALOG.items() for key in keys)


@query("catalog_keys", _keys_sql())
def catalog_keys(spark, sf_dir):
    """Proof of the candidate keys, which counts every table; a listing does not need it."""
    return verified_keys({name: table(spark, sf_dir, name) for name in CATALOG}, CATALOG)


@query("raw_history_landing", f"""
    SELECT 'run1' AS run_id, CAST(1 AS BIGINT) AS generation_id, strftime(ts, '{ISO}') AS cursor,
           '["' || event_id || '"]' AS primary_key, false AS deleted, event_id, event_type,
           '{RUN_AT}' AS synced_at
    FROM events
""")
def raw_history_landing(spark, sf_dir):
    spec = StreamSpec("events", ("event_id",), "ts")
    landed = enrich(table(spark, sf_dir, "events"), "run1", RUN_AT, "ts")
    store = TableStore(spark, fresh_dir(spark, "store"))
    store.append("_raw", "run1", raw_envelope(landed, spec, "run1", 1, RUN_AT))
    return store.read("_raw").select(
        F.col("_sync_run_id").alias("run_id"), F.col("_sync_generation_id").alias("generation_id"),
        F.col("_sync_cursor").alias("cursor"), F.col("_sync_primary_key").alias("primary_key"),
        F.col("_sync_deleted").alias("deleted"), "record.event_id", "record.event_type",
        F.col("record._sync_synced_at").alias("synced_at"),
    )


@query("sink_ndjson_projected", """
    SELECT '{"c_custkey":' || c_custkey || CASE WHEN c_mktsegment = 'MACHINERY' THEN ''
           ELSE ',"segment":"' || c_mktsegment || '"' END || ',"c_name":"' || c_name || '"}' AS line
    FROM customer
""")
def sink_ndjson_projected(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").withColumn(
        "segment", F.nullif(F.col("c_mktsegment"), F.lit("MACHINERY"))
    )
    path = fresh_dir(spark, "ndjson")
    to_ndjson(customers, ["c_custkey", "segment", "c_name"]).write.text(path)
    return spark.read.text(path).select(F.col("value").alias("line"))
