"""SQL surface and relational operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakesync.functions.values import iso_micros
from lakesync.operators.ordered import with_frame, with_position, with_running_total
from lakesync.operators.relational import asof_join, except_all, range_counts
from lakesync.plans import sql as guarded
from lakesync.queries.registry import query, table
from lakesync.queries.sources import ISO
from lakesync.sources.tables import TableStore
from lakesync.workspace import fresh_dir


def money(name: str):
    """Exact sum of a two-digit amount, shown as a double."""
    return F.sum(F.col(name).cast("decimal(18,2)")).cast("double")


def sql_money(name: str) -> str:
    return f"CAST(sum(CAST({name} AS DECIMAL(18,2))) AS DOUBLE)"


def _store(spark, sf_dir, *names: str) -> TableStore:
    store = TableStore(spark, fresh_dir(spark, "store"))
    for name in names:
        store.overwrite(name, f"run-{name}", table(spark, sf_dir, name))
    return store


@query("sql_views", """
    SELECT c_mktsegment, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey
    WHERE n_regionkey = 2 GROUP BY c_mktsegment
""")
def sql_views(spark, sf_dir):
    store = _store(spark, sf_dir, "customer", "nation")
    store.append("empty", "run-empty", table(spark, sf_dir, "region").where("false"))
    views = guarded.register_views(store)
    if views != ["customer", "nation"]:
        raise ValueError(f"unexpected views {views}")
    return spark.sql("""
        SELECT c_mktsegment, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey
        WHERE n_regionkey = 2 GROUP BY c_mktsegment
    """)


@query("sql_guarded", f"""
    SELECT o_orderstatus, {sql_money('o_totalprice')} AS total FROM orders GROUP BY o_orderstatus
""")
def sql_guarded(spark, sf_dir):
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    return guarded.query(spark, """
        WITH priced AS (SELECT o_orderstatus, CAST(o_totalprice AS DECIMAL(18,2)) AS p FROM orders)
        SELECT o_orderstatus, CAST(sum(p) AS DOUBLE) AS total FROM priced GROUP BY o_orderstatus
    """)


@query("sql_default_limit", """
    (SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25)
    UNION ALL
    (SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 7)
""")
def sql_default_limit(spark, sf_dir):
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    capped = guarded.query(spark, "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey", 25)
    own = guarded.query(spark, "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 7", 25)
    return capped.unionByName(own)


@query("sql_normalize_values", """
    SELECT user_id, CAST(count(*) AS BIGINT) AS n, strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') AS last_at,
           CAST(sum(event_id) AS DOUBLE) AS wide, 'u' || user_id AS name, min(value) AS low
    FROM events GROUP BY user_id
""")
def sql_normalize_values(spark, sf_dir):
    events = table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count("*").cast("decimal(10,0)").alias("n"), F.max("ts").alias("last_at"),
        F.sum(F.col("event_id").cast("decimal(20,0)")).alias("wide"), F.min("value").alias("low"),
    )
    name = F.encode(F.concat(F.lit("u"), F.col("user_id").cast("string")), "UTF-8")
    return guarded.normalize_values(events.withColumn("name", name))


@query("join_inner_agg", f"""
    SELECT c_custkey, c_name, {sql_money('o_totalprice')} AS total FROM customer JOIN orders ON c_custkey = o_custkey
    GROUP BY c_custkey, c_name ORDER BY total DESC, c_custkey
""")
def join_inner_agg(spark, sf_dir):
    # Totals first: the join then sees one row per customer, however hot a customer is.
    totals = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(money("o_totalprice").alias("total"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    joined = customers.join(totals, F.col("c_custkey") == F.col("o_custkey")).drop("o_custkey")
    return joined.orderBy(F.desc("total"), "c_custkey")


@query("join_left_outer", """
    SELECT d.doc_id, d.lang, l.quality, l.toxic, l.doc_id IS NULL AS unlabeled FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
""")
def join_left_outer(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    labels = table(spark, sf_dir, "labels").withColumn("labeled", F.lit(True))
    return docs.join(labels, "doc_id", "left").select(
        "doc_id", "lang", "quality", "toxic", F.col("labeled").isNull().alias("unlabeled")
    )


@query("join_anti", """
    SELECT c_custkey, c_name FROM customer c LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) o ON c_custkey = o_custkey WHERE o_orderkey IS NULL
""")
def join_anti(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    # Distinct keys first (combined before the shuffle), so a hot key cannot skew the join.
    large = table(spark, sf_dir, "orders").where(F.col("o_totalprice") > 300000)
    buyers = large.select(F.col("o_custkey").alias("c_custkey")).distinct()
    return customers.join(buyers, "c_custkey", "left_anti")


@query("join_semi", """
    SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)
""")
def join_semi(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    large = table(spark, sf_dir, "lineitem").where(F.col("l_quantity") > 45)
    return parts.join(large.select(F.col("l_partkey").alias("p_partkey")).distinct(), "p_partkey", "left_semi")


@query("join_full_outer", """
    SELECT coalesce(s_nationkey, c_nationkey) AS nationkey, suppliers, customers
    FROM (SELECT s_nationkey, count(*) AS suppliers FROM supplier WHERE s_acctbal > 2000 GROUP BY s_nationkey)
    FULL JOIN (SELECT c_nationkey, count(*) AS customers FROM customer WHERE c_acctbal < 2000 GROUP BY c_nationkey)
    ON s_nationkey = c_nationkey
""")
def join_full_outer(spark, sf_dir):
    suppliers = table(spark, sf_dir, "supplier").where(F.col("s_acctbal") > 2000).groupBy(
        F.col("s_nationkey").alias("nationkey")
    ).agg(F.count("*").alias("suppliers"))
    customers = table(spark, sf_dir, "customer").where(F.col("c_acctbal") < 2000).groupBy(
        F.col("c_nationkey").alias("nationkey")
    ).agg(F.count("*").alias("customers"))
    return suppliers.join(customers, "nationkey", "full")


@query("join_range", """
    SELECT s_suppkey, low, high, (SELECT count(*) FROM part WHERE p_retailprice >= low AND p_retailprice < high) AS points_in
    FROM (SELECT s_suppkey, CAST(floor(s_acctbal) AS DOUBLE) AS low, CAST(floor(s_acctbal) + 1 + s_suppkey % 3 * 200 AS DOUBLE) AS high FROM supplier)
""")
def join_range(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_retailprice")
    low = F.floor("s_acctbal").cast("double")
    spans = table(spark, sf_dir, "supplier").select("s_suppkey", low.alias("low"), (low + 1 + F.col("s_suppkey") % 3 * 200).alias("high"))
    return range_counts(parts, spans, "p_retailprice", "low", "high")


@query("join_asof", f"""
    SELECT e.event_id, e.user_id, strftime(s.ts, '{ISO}') AS signup_at, s.event_id AS signup_id
    FROM (SELECT * FROM events WHERE event_type = 'purchase') e
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') s ON e.user_id = s.user_id AND e.ts >= s.ts
""")
def join_asof(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    purchases = events.where(F.col("event_type") == "purchase").select("event_id", "user_id", "ts")
    signups = events.where(F.col("event_type") == "signup").select(
        "user_id", "ts", F.col("event_id").alias("signup_id"), F.col("ts").alias("signup_at")
    )
    joined = asof_join(
        purchases, signups, ["user_id"], "ts", "ts", ["signup_id", "signup_at"], "event_id", "signup_id"
    )
    return joined.select("event_id", "user_id", iso_micros(F.col("signup_at")).alias("signup_at"), "signup_id")


@query("agg_group_having", """
    SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 6
""")
def agg_group_having(spark, sf_dir):
    counted = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") > 6)


@query("agg_distinct_stats", """
    SELECT event_type, count(DISTINCT user_id) AS users, round(stddev_pop(value), 6) AS spread, min(value) AS low, max(value) AS high
    FROM events GROUP BY event_type
""")
def agg_distinct_stats(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count_distinct("user_id").alias("users"), F.round(F.stddev_pop("value"), 6).alias("spread"),
        F.min("value").alias("low"), F.max("value").alias("high"),
    )


_MULTI = "SELECT l_returnflag, l_linestatus, count(*) AS n, {total} AS quantity FROM lineitem GROUP BY {how}"


def _multi(spark, sf_dir, how: str):
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem")
    return guarded.query(spark, _MULTI.format(total=sql_money("l_quantity"), how=how))


_SETS = "GROUPING SETS ((l_returnflag), (l_linestatus), ())"


@query("agg_grouping_sets", _MULTI.format(total=sql_money("l_quantity"), how=_SETS))
def agg_grouping_sets(spark, sf_dir):
    return _multi(spark, sf_dir, _SETS)


@query("agg_rollup", _MULTI.format(total=sql_money("l_quantity"), how="ROLLUP (l_returnflag, l_linestatus)"))
def agg_rollup(spark, sf_dir):
    return _multi(spark, sf_dir, "ROLLUP (l_returnflag, l_linestatus)")


@query("agg_cube", _MULTI.format(total=sql_money("l_quantity"), how="CUBE (l_returnflag, l_linestatus)"))
def agg_cube(spark, sf_dir):
    return _multi(spark, sf_dir, "CUBE (l_returnflag, l_linestatus)")


@query("win_rank", """
    SELECT o_custkey, o_orderkey, row_number() OVER w AS position FROM orders
    WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
""")
def win_rank(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return with_position(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("win_frame", """
    SELECT o_custkey, o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (w ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS running,
           CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (w ROWS 2 PRECEDING) AS DOUBLE) AS moving,
           lag(o_orderkey) OVER w AS previous_order, lead(o_orderkey) OVER w AS next_order
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
""")
def win_frame(spark, sf_dir):
    price = F.col("o_totalprice").cast("decimal(18,2)")
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", price.alias("price"))
    keys, order = ["o_custkey"], ["o_orderdate", "o_orderkey"]
    framed = with_frame(
        orders, keys, order, before=2, after=1,
        outputs={
            "moving": lambda w: F.sum("price").over(w.rowsBetween(-2, 0)).cast("double"),
            "previous_order": lambda w: F.lag("o_orderkey").over(w),
            "next_order": lambda w: F.lead("o_orderkey").over(w),
        },
    )
    totals = with_running_total(framed, keys, order, {"running": F.col("price")})
    return totals.withColumn("running", F.col("running").cast("double")).drop("price", "o_orderdate")


@query("sort_topk", """
    SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50
""")
def sort_topk(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50)


def _two_sides(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.floor(F.col("c_acctbal") / 1000).alias("band"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.floor(F.col("s_acctbal") / 1000).alias("band"))
    return customers, suppliers


_C = "SELECT c_nationkey AS k, CAST(floor(c_acctbal / 1000) AS BIGINT) AS band FROM customer"
_S = "SELECT s_nationkey AS k, CAST(floor(s_acctbal / 1000) AS BIGINT) AS band FROM supplier"


@query("set_union_all", f"{_C} UNION ALL {_S}")
def set_union_all(spark, sf_dir):
    customers, suppliers = _two_sides(spark, sf_dir)
    return customers.union(suppliers)


@query("set_union_distinct", f"{_C} UNION {_S}")
def set_union_distinct(spark, sf_dir):
    customers, suppliers = _two_sides(spark, sf_dir)
    return customers.union(suppliers).distinct()


@query("set_intersect", f"{_C} INTERSECT {_S}")
def set_intersect(spark, sf_dir):
    customers, suppliers = _two_sides(spark, sf_dir)
    # Copies are merged before the shuffle of the match.
    return customers.distinct().intersect(suppliers.distinct())


@query("set_except", f"{_C} EXCEPT ALL {_S}")
def set_except(spark, sf_dir):
    customers, suppliers = _two_sides(spark, sf_dir)
    return except_all(customers, suppliers)


_CTE = """
    WITH spend AS (SELECT o_custkey, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total FROM orders GROUP BY o_custkey)
    SELECT o_custkey, CAST(total AS DOUBLE) AS total FROM spend
    WHERE total > (SELECT 1.5 * avg(total) FROM spend)
      AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'MACHINERY')
"""


@query("sql_cte_subquery", _CTE)
def sql_cte_subquery(spark, sf_dir):
    for name in ("orders", "customer"):
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    return guarded.query(spark, _CTE)


_STEPS = """
        SELECT o_custkey, o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS price,
               lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous,
               lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS following
        FROM orders"""

_WALK = """
    chain AS (
        SELECT o_custkey, o_orderkey, previous, CAST(1 AS BIGINT) AS depth, CAST(price AS DECIMAL(28,2)) AS spent FROM steps WHERE following IS NULL
        UNION ALL
        SELECT s.o_custkey, s.o_orderkey, s.previous, c.depth + 1, CAST(c.spent + s.price AS DECIMAL(28,2))
        FROM chain c JOIN steps s ON s.o_orderkey = c.previous AND s.o_custkey = c.o_custkey)
    SELECT o_custkey, o_orderkey, depth, CAST(spent AS DOUBLE) AS spent FROM chain
"""

_CHAIN = f"""
    WITH RECURSIVE steps AS ({_STEPS}),{_WALK}"""

#: Rows of a part of the steps, which every level of the recursion reads as it lies.
_PART_ROWS = 250_000


@query("sql_recursive_chain", _CHAIN)
def sql_recursive_chain(spark, sf_dir):
    """From the last order of each customer back to the first: as deep as the customer with most orders.

    Every level joins all steps, so they are written once, and kept dealt and sorted by the keys of that join for as long as
    the session has room; a level then sorts and shuffles the orders of its own depth only.
    """
    orders = table(spark, sf_dir, "orders")
    orders.createOrReplaceTempView("orders")
    size = orders.groupBy("o_custkey").count().agg(F.max("count").alias("most"), F.sum("count").alias("rows")).first()
    path = fresh_dir(spark, "chain-steps")  # a new path each time, so nothing kept is taken for another table's steps
    guarded.query(spark, _STEPS).write.parquet(path)
    parts = (size.rows or 0) // _PART_ROWS + 1
    keys = ("o_orderkey", "o_custkey")
    spark.read.parquet(path).repartition(parts, *keys).sortWithinPartitions(*keys).persist().createOrReplaceTempView("steps")
    return guarded.query(spark, f"WITH RECURSIVE {_WALK}", max_depth=(size.most or 0) + 1)


@query("expr_null_nan", """
    SELECT event_id, coalesce(CASE WHEN event_id % 3 <> 0 THEN value END, -1) AS filled, event_id % 3 = 0 AS is_missing,
           event_id % 5 = 0 AS is_nan, event_id % 7 = 0 AND event_id % 5 <> 0 AS is_inf
    FROM events
""")
def expr_null_nan(spark, sf_dir):
    key = F.col("event_id")
    odd = F.when(key % 5 == 0, F.lit(float("nan"))).when(key % 7 == 0, F.lit(float("-inf"))).otherwise(F.col("value"))
    rows = table(spark, sf_dir, "events").select(
        "event_id", F.when(key % 3 != 0, F.col("value")).alias("v"), odd.alias("x")
    )
    return rows.select(
        "event_id", F.coalesce("v", F.lit(-1.0)).alias("filled"), F.col("v").isNull().alias("is_missing"),
        F.isnan("x").alias("is_nan"), (F.abs("x") == F.lit(float("inf"))).alias("is_inf"),
    )


@query("fn_string_date_math", """
    SELECT p_partkey, upper(p_name) AS loud, substr(p_brand, 7) AS brand_no, length(p_type) AS type_size,
           replace(p_name, ' ', '_') AS slug, round(p_retailprice, 0) AS gross, p_size % 7 AS rest,
           CAST(floor(sqrt(p_size)) AS BIGINT) AS root, strftime(DATE '2024-01-31' + CAST(p_size AS INTEGER), '%Y-%m-%d') AS due,
           CAST(month(DATE '2024-01-31' + CAST(p_size AS INTEGER)) AS INTEGER) AS due_month
    FROM part
""")
def fn_string_date_math(spark, sf_dir):
    due = F.date_add(F.lit("2024-01-31").cast("date"), F.col("p_size"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.upper("p_name").alias("loud"), F.expr("substring(p_brand, 7)").alias("brand_no"),
        F.length("p_type").cast("bigint").alias("type_size"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("slug"),
        F.round("p_retailprice", 0).alias("gross"), (F.col("p_size") % 7).alias("rest"),
        F.floor(F.sqrt("p_size")).alias("root"), F.date_format(due, "yyyy-MM-dd").alias("due"), F.month(due).alias("due_month"),
    )


@query("fn_array_map_json", """
    SELECT vec_id, CAST(len(embedding) AS BIGINT) AS dims, embedding[1] AS first_value, list_max(embedding) AS top,
           CAST(len(list_filter(embedding, lambda x: x > 0)) AS BIGINT) AS positive, k
    FROM embeddings LEFT JOIN (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) ON vec_id = event_id
""")
def fn_array_map_json(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("vec_id"), F.get_json_object("props", "$.k").cast("bigint").alias("k")
    )
    vectors = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.size("embedding").cast("bigint").alias("dims"), F.get("embedding", F.lit(0)).alias("first_value"),
        F.array_max("embedding").alias("top"),
        F.size(F.filter("embedding", lambda x: x > 0)).cast("bigint").alias("positive"),
    )
    return vectors.join(events, "vec_id", "left")
