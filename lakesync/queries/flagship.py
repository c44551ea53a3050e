"""The whole way of a stream: land, deduplicate, publish, query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakesync.operators.sync import StreamSpec
from lakesync.plans import sql
from lakesync.plans.sync_run import run_sync
from lakesync.queries.registry import query, table
from lakesync.queries.sources import RUN_AT
from lakesync.sources.tables import TableStore
from lakesync.workspace import fresh_dir

_TOTALS = """
    SELECT c_mktsegment, count(*) AS customers, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
    FROM latest_orders JOIN buyers ON o_custkey = c_custkey
    GROUP BY c_mktsegment ORDER BY total DESC
"""


@query("latest_order_totals", f"""
    WITH latest_orders AS (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1),
         buyers AS (SELECT * FROM customer)
    {_TOTALS}
""")
def latest_order_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = TableStore(spark, fresh_dir(spark, "store"))
    spec = StreamSpec("orders", ("o_custkey",), "o_orderkey", "latest_orders")
    run_sync(store, table(spark, sf_dir, "orders"), spec, "full_refresh_overwrite_deduped", "run1", RUN_AT)
    store.append("buyers", "run2", table(spark, sf_dir, "customer"))
    sql.register_views(store)
    return sql.query(spark, _TOTALS)
