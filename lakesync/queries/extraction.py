"""Records out of landed bodies.

The bodies are text that Spark builds row by row from the given tables, so
their number grows with the tables; each query then opens them again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from lakesync.functions.values import first_non_blank
from lakesync.operators import extract, mapping
from lakesync.operators.sync import latest_per_key
from lakesync.queries.registry import query, table

DAY = "%Y-%m-%d"


def text(*parts: Column | str) -> Column:
    """Concatenation of literals and columns (columns as text)."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))



def _order_bodies(spark, sf_dir) -> DataFrame:
    """Per order: a list of two objects and a scalar, below a path."""
    key = F.col("o_orderkey")
    body = text(
        '{"data":{"items":[{"id":', key, ',"part":"a","price":', F.col("o_totalprice"), '},7,"x",{"id":', key,
        ',"part":"b","price":null}]},"total":', F.col("o_custkey"), ',"status":"', F.col("o_orderstatus"), '"}',
    )
    return table(spark, sf_dir, "orders").select(key.alias("body_id"), body.alias("body"))


@query("records_at_path", """
    SELECT o_orderkey AS body_id, o_orderkey AS id, p AS part,
           CASE WHEN p = 'a' THEN o_totalprice END AS price
    FROM orders, (VALUES ('a'), ('b')) v(p)
""")
def records_at_path(spark, sf_dir):
    return extract.records_at(
        _order_bodies(spark, sf_dir), "data.items", {"id": "bigint", "part": "string", "price": "double"}, ["body_id"]
    )


@query("records_at_root", """
    SELECT o_orderkey AS body_id, o_custkey AS total, o_orderstatus AS status FROM orders
""")
def records_at_root(spark, sf_dir):
    return extract.records_at(_order_bodies(spark, sf_dir), ".", {"total": "bigint", "status": "string"}, ["body_id"])


@query("records_keyed_object", """
    SELECT 'c' || c_custkey AS id, c_name AS name, c_acctbal AS balance FROM customer
    UNION ALL
    SELECT 'd' || c_custkey, c_mktsegment, NULL FROM customer
""")
def records_keyed_object(spark, sf_dir):
    key = F.col("c_custkey")
    body = text(
        '{"rows":{"c', key, '":{"name":"', F.col("c_name"), '","balance":', F.col("c_acctbal"), '},"n":5,"d', key,
        '":{"name":"', F.col("c_mktsegment"), '"},"z":null}}',
    )
    bodies = table(spark, sf_dir, "customer").select(body.alias("body"))
    return extract.records_keyed(bodies, "rows", {"name": "string", "balance": "double"}, "id")


@query("response_fields_merge", """
    SELECT o_orderkey AS body_id, o_orderkey AS id, o_custkey AS total,
           CASE WHEN o_orderkey % 3 = 0 THEN 'own' ELSE o_orderstatus END AS status
    FROM orders, (VALUES (1), (2)) v(n)
""")
def response_fields_merge(spark, sf_dir):
    key = F.col("o_orderkey")
    status = F.when(key % 3 == 0, "null").otherwise(text('"', F.col("o_orderstatus"), '"'))
    record = text('{"id":', key, ',"status":"own"}')
    body = text('{"meta":{"total":', F.col("o_custkey"), ',"status":', status, '},"rows":[', record, ",", record, "]}")
    bodies = table(spark, sf_dir, "orders").select(key.alias("body_id"), body.alias("body"))
    return extract.merge_response_fields(
        bodies, "rows", {"id": "bigint", "status": "string"},
        {"total": ("meta.total", "bigint"), "status": ("meta.status", "string")}, ["body_id"],
    )


@query("explode_child_rows", f"""
    SELECT o_orderkey AS order_id, strftime(o_orderdate, '{DAY}') AS creation_date,
           o_orderkey || '-' || n AS line_item_id, n AS quantity, o_totalprice * n AS total_value,
           'USD' AS total_currency
    FROM orders, generate_series(1, 4) g(n) WHERE n <= o_orderkey % 5
""")
def explode_child_rows(spark, sf_dir):
    key = F.col("o_orderkey")
    lines = F.transform(
        F.filter(F.array(*map(F.lit, range(1, 5))), lambda n: n <= key % 5),
        lambda n: text(
            '{"lineItemId":"', key, "-", n, '","quantity":', n, ',"total":{"value":', F.col("o_totalprice") * n,
            ',"currency":"USD"}}',
        ),
    )
    body = text(
        '{"orders":[{"orderId":', key, ',"creationDate":"', F.date_format("o_orderdate", "yyyy-MM-dd"),
        '","lineItems":[', F.array_join(lines, ","), "]}]}",
    )
    bodies = table(spark, sf_dir, "orders").select(body.alias("body"))
    return extract.child_rows(
        bodies, "orders", "lineItems",
        {"order_id": ("orderId", "bigint"), "creation_date": ("creationDate", "string")},
        {"line_item_id": ("lineItemId", "string"), "quantity": ("quantity", "bigint"),
         "total_value": ("total.value", "double"), "total_currency": ("total.currency", "string")},
    )


@query("first_element_projection", """
    SELECT o_orderkey AS order_id, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority END AS shipping_step,
           CASE WHEN o_orderkey % 4 <> 0 THEN 'cust ' || o_custkey END AS ship_to_name,
           CASE WHEN o_orderkey % 4 = 1 THEN 'city ' || (o_custkey % 9) END AS ship_to_city
    FROM orders
""")
def first_element_projection(spark, sf_dir):
    key = F.col("o_orderkey")
    address = F.when(key % 4 == 1, text(',"contactAddress":{"city":"city ', F.col("o_custkey") % 9, '"}')).otherwise("")
    first = text(
        '{"fulfillmentInstructionsType":"', F.col("o_orderpriority"), '","shippingStep":{"shipTo":{"fullName":"cust ',
        F.col("o_custkey"), '"', address, "}}}",
    )
    listed = F.when(key % 4 == 0, "").otherwise(text(first, ',{"fulfillmentInstructionsType":"later"}'))
    body = text('{"orderId":', key, ',"fulfillmentStartInstructions":[', listed, "]}")
    bodies = table(spark, sf_dir, "orders").select(body.alias("body"))
    return extract.first_element(
        bodies, ".", "fulfillmentStartInstructions", {"order_id": ("orderId", "bigint")},
        {"shipping_step": ("fulfillmentInstructionsType", "string"),
         "ship_to_name": ("shippingStep.shipTo.fullName", "string"),
         "ship_to_city": ("shippingStep.shipTo.contactAddress.city", "string")},
    )


@query("report_header_zip", """
    SELECT 'p' || (c_custkey % 3) AS property_id, c_mktsegment AS segment, 'n' || c_nationkey AS nation,
           CAST(c_custkey AS VARCHAR) AS sessions, CASE WHEN c_custkey % 2 = 0 THEN '1' END AS hits
    FROM customer
""")
def report_header_zip(spark, sf_dir):
    key = F.col("c_custkey")
    hits = F.when(key % 2 == 0, ',{"value":"1"}').otherwise("")
    body = text(
        '{"dimensionHeaders":[{"name":"segment"},{"name":"nation"}],"metricHeaders":[{"name":"sessions"},{"name":"hits"}],'
        '"rows":[{"dimensionValues":[{"value":"', F.col("c_mktsegment"), '"},{"value":"n', F.col("c_nationkey"),
        '"},{"value":"surplus"}],"metricValues":[{"value":"', key, '"}', hits, "]}]}",
    )
    bodies = table(spark, sf_dir, "customer").select(text("p", key % 3).alias("property"), body.alias("body"))
    return extract.report_rows(bodies, "property", "property_id", ["segment", "nation"], ["sessions", "hits"])


@query("report_positional_keys", f"""
    SELECT 'https://shop.example/' AS site_url, 'web' AS search_type, strftime(ts, '{DAY}') AS day, event_type AS page,
           CAST(NULL AS VARCHAR) AS device, event_id AS clicks, value AS position
    FROM events
""")
def report_positional_keys(spark, sf_dir):
    body = text(
        '{"rows":[{"keys":["', F.date_format("ts", "yyyy-MM-dd"), '","', F.col("event_type"), '"],"clicks":',
        F.col("event_id"), ',"position":', F.col("value"), "}]}",
    )
    bodies = table(spark, sf_dir, "events").select(body.alias("body"))
    return extract.positional_rows(
        bodies, ["day", "page", "device"], {"clicks": "bigint", "position": "double"},
        {"site_url": F.lit("https://shop.example/"), "search_type": F.lit("web")},
    )


@query("header_row_table", """
    SELECT CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_partkey % 3 <> 0 THEN p_name END AS name,
           CASE WHEN p_partkey % 3 <> 0 THEN '' END AS note
    FROM part WHERE p_partkey % 5 <> 0
""")
def header_row_table(spark, sf_dir):
    key = F.col("p_partkey")
    tail = F.when(key % 3 != 0, text(',"dropped","', F.col("p_name"), '",null,"extra"')).otherwise("")
    row = F.when(key % 5 != 0, text(",[", key, tail, "]")).otherwise("")
    body = text('[["ID","","Name","NOTE"]', row, "]")
    bodies = table(spark, sf_dir, "part").select(body.alias("body"))
    return extract.header_rows(bodies, ["id", "name", "note"])


@query("csv_body_snake_headers", """
    SELECT doc_id AS body_id, CAST(doc_id AS VARCHAR) AS event_id, text AS body_text,
           CASE WHEN doc_id % 2 = 0 THEN lang END AS appsflyer_lang
    FROM documents
    UNION ALL
    SELECT doc_id, 'second', 'a,"b"' || chr(10) || 'c', NULL FROM documents
""")
def csv_body_snake_headers(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    quoted = text('"', F.replace(F.col("text"), F.lit('"'), F.lit('""')), '"')
    tail = F.when(F.col("doc_id") % 2 == 0, text(",", F.col("lang"), ",surplus")).otherwise("")
    body = text(
        "Event  ID,Body-Text,Apps Flyer Lang\r\n", F.col("doc_id"), ",", quoted, tail, "\n\n", 'second,"a,""b""\nc"\n'
    )
    bodies = docs.select(F.col("doc_id").alias("body_id"), body.alias("body"))
    return extract.csv_body_rows(bodies, ["event_id", "body_text", "appsflyer_lang"], ["body_id"])


@query("parallel_arrays_to_rows", """
    SELECT 'S' || s_suppkey AS symbol, 'USD' AS currency, s_suppkey * 10 + i AS timestamp,
           s_acctbal + i AS open, CASE WHEN i < 2 THEN s_acctbal + i + 1 END AS high,
           CASE WHEN i <> 1 THEN s_acctbal END AS low, s_acctbal AS close, CAST(i AS DOUBLE) AS volume,
           CASE WHEN i = 0 THEN s_acctbal END AS adjclose
    FROM supplier, generate_series(0, 2) g(i)
""")
def parallel_arrays_to_rows(spark, sf_dir):
    key, price = F.col("s_suppkey"), F.col("s_acctbal")
    body = text(
        '{"chart":{"result":[{"meta":{"symbol":"S', key, '","currency":"USD"},"timestamp":[', key * 10, ",",
        key * 10 + 1, ",", key * 10 + 2, '],"indicators":{"quote":[{"open":[', price, ",", price + 1, ",", price + 2,
        '],"high":[', price + 1, ",", price + 2, '],"low":[', price, ",null,", price, '],"close":[', price, ",",
        price, ",", price, ",", price, '],"volume":[0,1,2]}],"adjclose":[{"adjclose":[', price, "]}]}}]}}",
    )
    bodies = table(spark, sf_dir, "supplier").select(body.alias("body"))
    return extract.parallel_series(bodies, dict.fromkeys(["open", "high", "low", "close", "volume", "adjclose"], "double"))


@query("date_keyed_series", f"""
    SELECT 'C' || o_custkey AS symbol, strftime(o_orderdate, '{DAY}') AS date, CAST(o_orderkey AS VARCHAR) AS open,
           '9' AS high, CAST(NULL AS VARCHAR) AS low, o_orderstatus AS close, '5' AS volume
    FROM orders WHERE strftime(o_orderdate, '{DAY}') > '1997-05-28'
    UNION ALL
    SELECT 'C' || o_custkey, '2030-01-01', '1', NULL, NULL, NULL, NULL FROM orders
""")
def date_keyed_series(spark, sf_dir):
    body = text(
        '{"Time Series (Daily)":{"', F.date_format("o_orderdate", "yyyy-MM-dd"), '":{"1. open":"', F.col("o_orderkey"),
        '","2. high":9,"4. close":"', F.col("o_orderstatus"), '","5. volume":"5"},"2030-01-01":{"1. open":"1"}}}',
    )
    bodies = table(spark, sf_dir, "orders").select(text("C", F.col("o_custkey")).alias("owner"), body.alias("body"))
    return extract.date_keyed_series(bodies, "Time Series (Daily)", "owner", lower="1997-05-28")


@query("spread_source_struct", """
    SELECT CAST(event_id AS VARCHAR) AS id, event_type AS kind, value AS amount FROM events
""")
def spread_source_struct(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    hits = events.select(
        F.col("event_id").cast("string").alias("_id"),
        F.struct(F.col("event_type").alias("kind"), F.col("value").alias("amount"), F.lit("inner").alias("id")).alias("_source"),
    )
    return extract.spread_struct(hits, "_source", id_from="_id")


@query("spread_attributes", """
    SELECT doc_id AS id, 'document' AS type, lang, n_chars AS size FROM documents
""")
def spread_attributes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.lit("document").alias("type"),
        F.struct("lang", F.col("n_chars").alias("size")).alias("attributes"),
    )
    return extract.spread_struct(docs, "attributes")


@query("xml_feed_items", """
    SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'g' || page_id WHEN page_id % 3 = 1 THEN url ELSE 'Page & ' || page_id END AS id,
           'Page & ' || page_id AS title, CASE WHEN page_id % 3 <> 2 THEN url ELSE '  ' END AS link,
           CAST(NULL AS VARCHAR) AS description, '2026-01-01' AS published_at
    FROM pages
    UNION ALL
    SELECT page_id, 'fixed', 'x', NULL, 'more', NULL FROM pages
""")
def xml_feed_items(spark, sf_dir):
    key = F.col("page_id")
    link = F.replace(F.col("url"), F.lit("&"), F.lit("&amp;"))
    body = text(
        "<rss><channel><title>feed</title><item><guid>", F.when(key % 3 == 0, text("g", key)).otherwise(" "), "</guid><link>",
        F.when(key % 3 != 2, link).otherwise("  "), "</link><title>Page &amp; ", key,
        "</title><pubDate>2026-01-01</pubDate></item>",
        "<item><guid>fixed</guid><title>x</title><description>more</description></item></channel></rss>",
    )
    bodies = table(spark, sf_dir, "pages").select("page_id", body.alias("body"))
    return extract.feed_items(bodies, ["page_id"])


@query("xml_typed_collection", """
    SELECT 'Ledger ' || s_suppkey AS name,
           CASE WHEN s_suppkey % 4 <> 0 THEN s_acctbal END AS opening_balance,
           CASE WHEN s_suppkey % 4 = 0 THEN 'n/a' END AS opening_balance_raw,
           CASE s_suppkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS is_revenue,
           CASE s_suppkey % 3 WHEN 2 THEN 'maybe' END AS is_revenue_raw
    FROM supplier
""")
def xml_typed_collection(spark, sf_dir):
    key = F.col("s_suppkey")
    flag = F.when(key % 3 == 0, "Yes").when(key % 3 == 1, "0").otherwise("maybe")
    body = text(
        "<COLLECTION><LEDGER><NAME>Ledger ", key, "</NAME><OPENINGBALANCE>",
        F.when(key % 4 == 0, "n/a").otherwise(text(" ", F.col("s_acctbal"))), "</OPENINGBALANCE><ISREVENUE>", flag,
        "</ISREVENUE></LEDGER></COLLECTION>",
    )
    bodies = table(spark, sf_dir, "supplier").select(body.alias("body"))
    return extract.typed_collection(
        bodies, "LEDGER",
        {"name": ("NAME", "string"), "opening_balance": ("OPENINGBALANCE", "number"), "is_revenue": ("ISREVENUE", "boolean")},
    )


@query("queue_messages", """
    SELECT 'm' || event_id AS message_id, CASE WHEN event_id % 2 = 0 THEN json(props)::VARCHAR ELSE 'plain ' || event_type END AS body,
           event_id % 2 = 0 AS body_is_json, CAST(user_id AS VARCHAR) AS sender_id, event_type AS event_type
    FROM events
""")
def queue_messages(spark, sf_dir):
    key = F.col("event_id")
    inner = F.when(key % 2 == 0, F.replace(F.col("props"), F.lit('"'), F.lit('\\"'))).otherwise(
        text("plain ", F.col("event_type"))
    )
    body = text(
        '[{"MessageId":"m', key, '","Body":"', inner, '","Attributes":[{"Name":"SenderId","Value":"', F.col("user_id"),
        '"}],"MessageAttributes":[{"Name":"event-Type","Value":{"StringValue":"', F.col("event_type"), '"}}]}]',
    )
    bodies = table(spark, sf_dir, "events").select(body.alias("body"))
    return extract.queue_messages(bodies, ["sender_id", "event_type"])


@query("scalar_array_rows", """
    SELECT CAST(c_custkey AS VARCHAR) AS customer_id, 'customers/' || c_custkey AS resource_name FROM customer
    UNION ALL
    SELECT CAST(c_nationkey AS VARCHAR), 'nations/x/' || c_nationkey FROM customer
""")
def scalar_array_rows(spark, sf_dir):
    body = text('{"resourceNames":["customers/', F.col("c_custkey"), '","nations/x/', F.col("c_nationkey"), '"]}')
    bodies = table(spark, sf_dir, "customer").select(body.alias("body"))
    return extract.scalar_rows(bodies, "resourceNames", "customer_id", "resource_name")


@query("attribute_value_unwrap", """
    SELECT 'part ' || p_partkey AS pk, CAST(p_size AS VARCHAR) AS size, p_size > 25 AS big,
           CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS brand, CAST(p_retailprice AS VARCHAR) AS price,
           CASE WHEN p_partkey % 5 = 0 THEN 'deep ' || p_size END AS deep,
           CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name || '=' || (p_size > 10) || ',' || p_type || '=-' END AS tags,
           CASE WHEN p_partkey % 7 = 0 THEN '{"k":"' || p_size || '"}' WHEN p_partkey % 7 = 1 THEN 'true' ELSE p_brand END AS mixed
    FROM part
""")
def attribute_value_unwrap(spark, sf_dir):
    """Nothing is declared: the columns, nested maps and lists are found in the bodies."""
    key, size = F.col("p_partkey"), F.col("p_size")
    brand = F.when(key % 2 == 0, text('{"S":"', F.col("p_brand"), '"}')).otherwise('{"NULL":true}')
    deep = F.when(key % 5 == 0, text(',"more.of it":{"M":{"deep":{"M":{"it\'s":{"S":"deep ', size, '"}}}}}')).otherwise("")
    tags = F.when(key % 3 == 0, "").otherwise(text(
        '{"M":{"name":{"S":"', F.col("p_name"), '"},"flag":{"BOOL":', size > 10, '}}},7,{"M":{"name":{"S":"', F.col("p_type"), '"},"no":5}}'))
    mixed = F.when(key % 7 == 0, text('{"M":{"k":{"N":"', size, '"}}}')).when(key % 7 == 1, '{"BOOL":true}').otherwise(text('{"S":"', F.col("p_brand"), '"}'))
    body = text(
        '{"pk":{"S":"part ', key, '"},"size":{"N":"', size, '"},"big":{"BOOL":', size > 25, '},"info":{"M":{"brand":', brand,
        ',"price":{"N":"', F.col("p_retailprice"), '"}', deep, '}},"tags":{"L":[', tags, ']},"mixed":', mixed, "}",
    )
    rows = mapping.unwrap_found(table(spark, sf_dir, "part").select(body.alias("body")))
    each = F.transform("tags", lambda t: F.concat(t["name"], F.lit("="), F.coalesce(t["flag"].cast("string"), F.lit("-"))))
    return rows.select("pk", "size", "big", "info.brand", "info.price", F.col("info")["more.of it"]["deep"]["it's"].alias("deep"),
                       F.array_join(each, ",").alias("tags"), "mixed")


@query("attribute_value_declared", """
    SELECT 'part ' || p_partkey AS pk, CAST(p_size AS VARCHAR) AS size, p_size > 25 AS big,
           CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS brand, p_retailprice AS price,
           p_name || ',' || p_type AS tags
    FROM part
""")
def attribute_value_declared(spark, sf_dir):
    nested = F.when(F.col("p_partkey") % 2 == 0, text('{"S":"', F.col("p_brand"), '"}')).otherwise('{"NULL":true}')
    body = text(
        '{"pk":{"S":"part ', F.col("p_partkey"), '"},"size":{"N":"', F.col("p_size"), '"},"big":{"BOOL":', F.col("p_size") > 25,
        '},"info":{"M":{"brand":', nested, ',"price":{"N":"', F.col("p_retailprice"), '"}}},"tags":{"L":[{"S":"',
        F.col("p_name"), '"},7,{"S":"', F.col("p_type"), '"}]}}',
    )
    schema = T.StructType.fromDDL("pk string, size string, big boolean, info struct<brand:string,price:double>, tags array<string>")
    rows = extract.unwrap_items(table(spark, sf_dir, "part").select(body.alias("body")), schema)
    return rows.select("pk", "size", "big", "info.brand", "info.price", F.array_join("tags", ",").alias("tags"))


@query("first_non_blank", """
    SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type WHEN event_id % 3 = 1 THEN CAST(user_id AS VARCHAR)
                          ELSE 'stream' END AS id
    FROM events
""")
def first_non_blank_query(spark, sf_dir):
    key = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(
        "event_id", F.when(key % 3 == 0, F.col("event_type")).otherwise("  ").alias("a"),
        F.when(key % 3 != 2, F.col("user_id")).alias("b"),
    )
    chosen = first_non_blank([(F.col(n), rows.schema[n].dataType) for n in ("a", "b")], "stream")
    return rows.select("event_id", chosen.alias("id"))


@query("fan_out_parents", """
    SELECT CAST(o_custkey AS VARCHAR) AS customer_id, o_orderkey AS id, o_totalprice AS price
    FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')
""")
def fan_out_parents(spark, sf_dir):
    parents = table(spark, sf_dir, "customer").where(F.col("c_mktsegment") == "MACHINERY")
    body = text('[{"id":', F.col("o_orderkey"), ',"price":', F.col("o_totalprice"), "}]")
    bodies = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("body_id"), F.col("o_custkey").cast("string").alias("parent_id"), body.alias("body")
    )
    wanted = extract.fan_out(parents, "c_custkey", bodies, "customer_id")
    return extract.records_at(wanted, "", {"id": "bigint", "price": "double"}, ["customer_id"])


@query("time_window_chunks", """
    WITH w AS (
        SELECT event_id, user_id, ts, CAST(floor(epoch_us(ts - TIMESTAMP '2024-01-03') / (7 * 86400e6)) AS BIGINT) AS window_no
        FROM events WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-28')
    SELECT user_id, event_id, window_no,
           strftime(TIMESTAMP '2024-01-03' + to_days(CAST(7 * window_no AS INTEGER)), '%Y-%m-%d') AS window_start,
           strftime(least(TIMESTAMP '2024-01-03' + to_days(CAST(7 * window_no + 7 AS INTEGER)), TIMESTAMP '2024-01-28'), '%Y-%m-%d') AS window_end
    FROM w QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY window_no, ts, event_id) = 1
""")
def time_window_chunks(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    rows = extract.time_windows(events, "ts", "2024-01-03", "2024-01-28", 7)
    # First row per id over all windows: greatest by the reversed order.
    earliest = [-F.col("window_no"), -F.unix_micros(F.col("ts").cast("timestamp")), -F.col("event_id")]
    first = latest_per_key(rows, ["user_id"], earliest)
    day = "yyyy-MM-dd"
    return first.select(
        "user_id", "event_id", "window_no", F.date_format("window_start", day).alias("window_start"),
        F.date_format("window_end", day).alias("window_end"),
    )


@query("time_window_days", """
    SELECT event_id, CAST(datediff('day', DATE '2024-01-03', CAST(ts AS DATE)) // 5 AS BIGINT) AS window_no,
           strftime(least(DATE '2024-01-03' + CAST(5 * (datediff('day', DATE '2024-01-03', CAST(ts AS DATE)) // 5) + 4 AS INTEGER), DATE '2024-01-25'), '%Y-%m-%d') AS window_end
    FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-03' AND DATE '2024-01-25'
""")
def time_window_days(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "ts")
    rows = extract.time_windows(events, "ts", "2024-01-03", "2024-01-25", 5, inclusive_days=True)
    return rows.select("event_id", "window_no", F.date_format("window_end", "yyyy-MM-dd").alias("window_end"))
