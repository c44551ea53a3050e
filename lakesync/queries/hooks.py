"""Sources, writers and schema mappings of one's own."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, functions as F, types as T

from lakesync.operators import extract, writeback
from lakesync.operators.mapping import in_turn, renamed, retyped
from lakesync.operators.sync import StreamSpec
from lakesync.plans.sync_run import run_sync
from lakesync.queries.extraction import text
from lakesync.queries.registry import query, table
from lakesync.queries.sources import RUN_AT
from lakesync.sources.hooks import Bound, LandedBodies, PayloadFiles, read_hook, read_payloads, write_hook
from lakesync.sources.tables import TableStore
from lakesync.workspace import fresh_dir


@query("stream_hook_bodies", """
    SELECT year(o_orderdate) AS o_year, count(*) AS rows_read, count(DISTINCT o_custkey) AS customers, max(o_totalprice) AS top_price,
           (SELECT count(DISTINCT year(o_orderdate)) FROM orders WHERE year(o_orderdate) >= 1996) AS slices
    FROM orders WHERE year(o_orderdate) >= 1996 GROUP BY ALL
""")
def stream_hook_bodies(spark, sf_dir):
    """Bodies landed by year and read through a hook; the bound on the year leaves out slices before they are opened."""
    orders = table(spark, sf_dir, "orders").withColumn("o_year", F.year("o_orderdate").cast("bigint"))
    body = text('{"key":', F.col("o_orderkey"), ',"customer":', F.col("o_custkey"), ',"price":', F.col("o_totalprice"), "}")
    landed = fresh_dir(spark, "landed-bodies")
    orders.select("o_year", body.alias("body")).repartition("o_year").write.partitionBy("o_year").text(landed)
    bodies = read_hook(spark, "landed_bodies", LandedBodies(("o_year",), slice_bytes=1 << 30), [Bound("o_year", ">=", 1996)], path=landed)
    rows = extract.records_at(bodies, "", {"key": "bigint", "customer": "bigint", "price": "double"}, ["o_year", "slices"])
    return rows.groupBy("o_year", "slices").agg(
        F.count("*").alias("rows_read"), F.count_distinct("customer").alias("customers"), F.max("price").alias("top_price"))


@query("write_hook_payloads", """
    SELECT run, CASE WHEN run = 'refused' THEN NULL ELSE payload END AS payload FROM (
        SELECT 'first' AS run, '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '"}' AS payload FROM customer
        UNION ALL SELECT 'second', '{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '"}' FROM customer WHERE c_custkey % 2 = 0)
    UNION ALL SELECT 'refused', NULL
""")
def write_hook_payloads(spark, sf_dir):
    """Payloads handed over in two runs; a third one fails at one payload of many and leaves nothing."""
    customers, path = table(spark, sf_dir, "customer"), fresh_dir(spark, "payloads")
    names = writeback.json_payload(customers, body_fields=["c_custkey", "c_name"]).alias("payload")
    segments = writeback.json_payload(customers, body_fields=["c_custkey", "c_mktsegment"]).alias("payload")
    write_hook(customers.select(names), "payload_files", PayloadFiles(), path=path, run="first")
    write_hook(customers.where(F.col("c_custkey") % 2 == 0).select(segments), "payload_files", PayloadFiles(), path=path, run="second")
    refused = customers.select(names).orderBy("payload").first().payload
    try:
        write_hook(customers.select(names), "payload_files", PayloadFiles(refuse=refused), path=path, run="refused")
    except PySparkException:
        pass  # the run that is to fail
    sent = [read_payloads(spark, path, run).withColumn("run", F.lit(run)) for run in ("first", "second", "refused")]
    nothing = spark.range(1).select(F.lit("refused").alias("run"), F.lit(None).cast("string").alias("payload"))
    columns: list[DataFrame] = [s.select("run", "payload") for s in sent]
    return columns[0].unionByName(columns[1]).unionByName(columns[2]).unionByName(nothing)


@query("schema_mapped_landing", """
    SELECT o_orderkey AS id, CAST(o_custkey AS VARCHAR) AS customer_id, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS ordered_at,
           CAST(o_totalprice AS DOUBLE) AS total, NULL::VARCHAR AS note
    FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1
""")
def schema_mapped_landing(spark, sf_dir):
    """Columns renamed, retyped and added by a mapper before they land; key and cursor go by their new names."""
    def with_note(schema: T.StructType) -> T.StructType:
        return T.StructType([*schema.fields, T.StructField("note", T.StringType())])

    def customer_as_text(schema: T.StructType) -> T.StructType:
        return T.StructType([T.StructField(f.name, T.StringType() if f.name == "customer_id" else f.dataType, True, f.metadata) for f in schema.fields])

    names = {"o_orderkey": "id", "o_custkey": "customer_id", "o_orderdate": "ordered_at", "o_totalprice": "total"}
    times_as_text = retyped({T.TimestampNTZType: T.StringType(), T.TimestampType: T.StringType()})
    mapper = in_turn(renamed(names), times_as_text, customer_as_text, with_note)
    orders, store = table(spark, sf_dir, "orders").select(*names), TableStore(spark, fresh_dir(spark, "store"))
    # The latest order of a customer: equal times are told apart by the key, in the cursor's text.
    latest = orders.groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey", "o_totalprice")).alias("m"))
    picked = latest.select("m.o_orderkey", "o_custkey", "m.o_orderdate", "m.o_totalprice")
    run_sync(store, picked, StreamSpec("orders", ("customer_id",), "ordered_at"), "incremental_append_deduped", "run1", RUN_AT, mapper=mapper)
    return store.read("orders").select("id", "customer_id", "ordered_at", "total", "note")
