"""Write-back: customers become contacts, payloads, batches and outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lakesync.operators import writeback
from lakesync.functions.values import row_hash
from lakesync.queries.extraction import text
from lakesync.queries.registry import query, table
from lakesync.queries.schemas import SCHEMA, event_records, _RECORD
from lakesync.sources.tables import TableStore
from lakesync.workspace import fresh_dir

MAPPINGS = {"c_custkey": "external_id", "c_name": "name", "c_mktsegment": "segment", "c_phone": "phone"}
_MAPPED = "SELECT c_custkey AS external_id, c_name AS name, c_mktsegment AS segment, CAST(NULL AS VARCHAR) AS phone FROM customer"
_ROW_TEXT = """'external_id=' || external_id || ';name=' || to_json(name)::VARCHAR || ';phone=null;segment=' || to_json(segment)::VARCHAR || ';'"""


def mapped(spark, sf_dir, plan_id: str | None = None) -> DataFrame:
    return writeback.map_fields(table(spark, sf_dir, "customer"), MAPPINGS, plan_id)


@query("map_fields", f"SELECT *, 'plan1' AS _sync_reverse_plan_id FROM ({_MAPPED})")
def map_fields(spark, sf_dir):
    return mapped(spark, sf_dir, "plan1")


_SETTINGS = {"name": "contacts", "action": "upsert", "source_table": "customer"}


@query("plan_hash", f"""
    WITH b AS (SELECT CAST('0x' || substr(sha256({_ROW_TEXT}), 1, 15) AS BIGINT) AS bits FROM ({_MAPPED})),
         f AS (SELECT count(*) AS row_count, bit_xor(bits) AS xor_bits, CAST(sum(bits) AS VARCHAR) AS sum_bits FROM b)
    SELECT row_count, xor_bits, sum_bits, sha256(row_count || ':' || xor_bits || ':' || sum_bits) AS fingerprint,
           sha256('action=upsert;name=contacts;source_table=customer;' || sha256(row_count || ':' || xor_bits || ':' || sum_bits)) AS plan_hash
    FROM f
""")
def plan_hash(spark, sf_dir):
    return writeback.plan_hash(mapped(spark, sf_dir), _SETTINGS)


@query("plan_row_hashes", f"SELECT external_id, sha256({_ROW_TEXT}) AS row_hash FROM ({_MAPPED})")
def plan_row_hashes(spark, sf_dir):
    rows = mapped(spark, sf_dir)
    return rows.select("external_id", row_hash(rows.schema, rows.columns).alias("row_hash"))


@query("plan_preview", f"""
    SELECT *, (SELECT count(*) FROM customer) AS record_count, 'upsert' AS action FROM ({_MAPPED}) ORDER BY external_id LIMIT 3
""")
def plan_preview(spark, sf_dir):
    return writeback.plan_preview(mapped(spark, sf_dir), ["external_id"], "")


@query("plan_changed_rows", f"""
    WITH now_rows AS (SELECT external_id, CASE WHEN external_id % 100 = 3 THEN 'renamed' ELSE name END AS name, segment FROM ({_MAPPED}) WHERE external_id % 100 <> 7),
         a AS (SELECT sha256({_ROW_TEXT}) AS row_hash FROM ({_MAPPED})), b AS (SELECT sha256({_ROW_TEXT}) AS row_hash FROM now_rows)
    SELECT row_hash, CAST(1 AS BIGINT) AS planned_n, CAST(0 AS BIGINT) AS current_n, 'removed' AS change FROM a WHERE row_hash NOT IN (SELECT row_hash FROM b)
    UNION ALL
    SELECT row_hash, 0, 1, 'added' FROM b WHERE row_hash NOT IN (SELECT row_hash FROM a)
""")
def plan_changed_rows(spark, sf_dir):
    planned = mapped(spark, sf_dir)
    key = F.col("external_id")
    renamed = F.when(key % 100 == 3, "renamed").otherwise(F.col("name"))
    current = planned.where(key % 100 != 7).withColumn("name", renamed)
    return writeback.changed_rows(planned, current)


@query("plan_status", """
    WITH p AS (SELECT o_orderkey AS plan_id, o_orderkey % 6 AS s, o_orderdate + INTERVAL 24 HOUR AS expires_at FROM orders),
         q AS (SELECT *, CASE s WHEN 1 THEN 'executing' WHEN 2 THEN 'executed' WHEN 3 THEN 'failed' WHEN 4 THEN 'invalidated' ELSE 'planned' END AS status FROM p)
    SELECT plan_id, status, CASE WHEN status = 'planned' AND TIMESTAMP '1999-01-01' > expires_at THEN 'expired' ELSE status END AS status_now,
           status = 'planned' AND TIMESTAMP '1999-01-01' <= expires_at AND plan_id % 5 <> 0 AS can_run
    FROM q
""")
def plan_status(spark, sf_dir):
    key = F.col("o_orderkey")
    names = F.array(*map(F.lit, ["planned", "executing", "executed", "failed", "invalidated", "planned"]))
    plans = table(spark, sf_dir, "orders").select(
        key.alias("plan_id"), F.get(names, (key % 6).cast("int")).alias("status"),
        F.timestamp_add("HOUR", F.lit(24), F.col("o_orderdate")).alias("expires_at"),
        F.when(key % 5 != 0, F.sha2(key.cast("string"), 256)).alias("token_hash"),
    )
    now = F.to_timestamp_ntz(F.lit("1999-01-01"))
    return writeback.plan_status(plans, now).drop("expires_at", "token_hash")


@query("write_validate", f"""
    SELECT event_id AS record_index, CASE
        WHEN NOT has_id THEN '/id: required property missing' WHEN has_extra THEN '/extra: additional property not allowed'
        WHEN text_amount THEN '/amount: value does not match type [''number'', ''null'']'
        WHEN user_id > 99 THEN '/code: value does not match pattern' WHEN k > 94 THEN '/meta/k: value not in enum'
        WHEN bad_tag THEN '/tags/1: value does not match type [''string'']' WHEN event_type = 'error' THEN '/type: value not in enum'
        ELSE 'valid' END AS violation
    FROM ({_RECORD}) JOIN (SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events) USING (event_id)
""")
def write_validate(spark, sf_dir):
    valid, rejected = writeback.validate_write(event_records(spark, sf_dir), "record", SCHEMA, "event_id")
    good = valid.select(F.col("event_id").alias("record_index"), F.lit("valid").alias("violation"))
    return good.unionByName(rejected)


@query("payload_json", """
    SELECT c_custkey, '{"c_name":"' || c_name || '","c_nationkey":' || c_nationkey || ',"c_mktsegment":"' || c_mktsegment || '"}' AS body,
           '{"c_name":"' || c_name || '"}' AS delete_body
    FROM customer
""")
def payload_json(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").drop("c_acctbal")
    return rows.select(
        "c_custkey", writeback.json_payload(rows, path_fields=["c_custkey"]).alias("body"),
        writeback.json_payload(rows, body_fields=["c_name", "c_fax"]).alias("delete_body"),
    )


@query("payload_form", """
    SELECT p_partkey, 'name=' || replace(url_encode(p_name), '%20', '+') || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE '&note=a%26b' END ||
           '&price=' || CASE WHEN p_retailprice = floor(p_retailprice) THEN CAST(CAST(p_retailprice AS BIGINT) AS VARCHAR) ELSE CAST(p_retailprice AS VARCHAR) END ||
           '&size=' || p_size AS body
    FROM part
""")
def payload_form(spark, sf_dir):
    key = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_size").alias("size"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"),
        F.when(key % 2 == 1, "a&b").when(key % 4 == 0, "").alias("note"),
    )
    return rows.select("p_partkey", writeback.form_payload(rows, ["p_partkey"]).alias("body"))


@query("payload_array", """
    SELECT o_orderkey, '["' || o_orderstatus || '","' || o_orderpriority || '"]' AS body FROM orders
""")
def payload_array(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.array("o_orderstatus", "o_orderpriority").alias("tags"))
    return rows.select("o_orderkey", writeback.array_payload(rows, "tags").alias("body"))


_CONTACTS = """
    SELECT c_custkey AS n, CASE WHEN c_custkey % 11 <> 0 THEN 'u' || (c_custkey % 97) || '@example.com' END AS email,
           CASE WHEN c_custkey % 13 = 0 THEN 'example.com' END AS domain, c_name AS name FROM customer
"""
_KEY = "concat_ws('|', 'email=' || email, 'domain=' || domain)"


def contact_rows(spark, sf_dir) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("n"), F.when(key % 11 != 0, text("u", key % 97, "@example.com")).alias("email"),
        F.when(key % 13 == 0, "example.com").alias("domain"), F.col("c_name").alias("name"),
    )


@query("action_dedupe", f"""
    SELECT n, email, domain, name FROM ({_CONTACTS})
    QUALIFY {_KEY} = '' OR row_number() OVER (PARTITION BY {_KEY} ORDER BY n DESC) = 1
""")
def action_dedupe(spark, sf_dir):
    return writeback.dedupe_actions(contact_rows(spark, sf_dir), "n")


_RECORD_ID = """sha256('sales/push:domain=' || coalesce(to_json(domain)::VARCHAR, 'null') || ';email=' || coalesce(to_json(email)::VARCHAR, 'null') || ';n=' || n || ';name=' || to_json(name)::VARCHAR || ';')"""


def stamped(spark, sf_dir) -> DataFrame:
    rows = contact_rows(spark, sf_dir)
    return rows.withColumn("record_id", writeback.record_id(rows.schema, rows.columns, "sales", "push"))


@query("deterministic_record_id", f"SELECT n, {_RECORD_ID} AS record_id FROM ({_CONTACTS})")
def deterministic_record_id(spark, sf_dir):
    return stamped(spark, sf_dir).select("n", "record_id")


@query("skip_already_sent", f"SELECT n, {_RECORD_ID} AS record_id FROM ({_CONTACTS}) WHERE n % 3 <> 0")
def skip_already_sent(spark, sf_dir):
    rows, store = stamped(spark, sf_dir), TableStore(spark, fresh_dir(spark, "store"))
    # An earlier run sent every third row and kept what arrived.
    arrived = rows.where(F.col("n") % 3 == 0).select("record_id", F.lit("succeeded").alias("outcome"), F.col("record_id").alias("mapped_id"))
    writeback.keep_identity(store, "identity", "run1", arrived)
    return writeback.skip_sent(rows, writeback.known_identity(store, "identity")).select("n", "record_id")


@query("batch_failure_dead_letters", f"""
    SELECT {_RECORD_ID} AS record_id, CASE WHEN n // 10 % 7 = 3 THEN 'no connection' ELSE 'destination rejected record' END AS error,
           CASE WHEN n // 10 % 7 = 3 THEN 4 ELSE 1 END AS attempts, '{{"email":"[REDACTED]"}}' AS record,
           'contacts' AS flow, 'send' AS step, 'run1' AS run_id
    FROM ({_CONTACTS}) WHERE n % 4 = 1 OR n // 10 % 7 = 3
""")
def batch_failure_dead_letters(spark, sf_dir):
    """Some batches fail as a whole, rows of others one by one; all of it ends in the stored dead letters."""
    store = TableStore(spark, fresh_dir(spark, "store"))
    batched = outcomes(spark, sf_dir).withColumn("batch_no", F.floor(F.col("n") / 10))
    failures = batched.where(F.col("batch_no") % 7 == 3).select("batch_no", F.lit("no connection").alias("error"), F.lit(3).alias("retries")).distinct()
    settled = writeback.with_batch_failures(batched, failures)
    letters = writeback.dead_letters(
        settled, ["email"], F.coalesce("batch_error", F.lit("destination rejected record")), F.coalesce("batch_attempts", F.lit(1)))
    writeback.keep_dead_letters(store, "dead_letters", "contacts", "send", "run1", letters)
    return store.read("dead_letters")


@query("batch_assign", """
    SELECT o_orderkey, i AS row_index, i // 100 AS batch_no, i % 100 AS batch_pos
    FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_orderkey) - 1 AS i FROM orders)
""")
def batch_assign(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return writeback.assign_batches(rows, ["o_orderpriority", "o_orderkey"]).drop("o_orderpriority")


def outcomes(spark, sf_dir) -> DataFrame:
    rows, n = stamped(spark, sf_dir), F.col("n")
    responses = rows.where(n % 4 != 3).select(
        "record_id", (n % 4 == 1).alias("failed"), F.when(n % 4 == 2, text("ext-", n)).alias("external_id")
    )
    return writeback.delivery_outcomes(rows, responses)


@query("delivery_outcomes", f"""
    SELECT n, CASE WHEN n % 4 = 1 THEN 'dead_letter' ELSE 'succeeded' END AS outcome,
           CASE WHEN n % 4 = 1 THEN NULL WHEN n % 4 = 2 THEN 'ext-' || n ELSE {_RECORD_ID} END AS mapped_id
    FROM ({_CONTACTS})
""")
def delivery_outcomes(spark, sf_dir):
    return outcomes(spark, sf_dir).select("n", "outcome", "mapped_id")


@query("dead_letter", f"""
    SELECT {_RECORD_ID} AS record_id, 'destination rejected record' AS error, 1 AS attempts,
           '{{"n":"[REDACTED]","email":"[REDACTED]","domain":"[REDACTED]","name":"[REDACTED]"}}' AS record
    FROM ({_CONTACTS}) WHERE n % 4 = 1
""")
def dead_letter(spark, sf_dir):
    fields = ["n", "email", "domain", "name"]
    return writeback.dead_letters(outcomes(spark, sf_dir), fields, "destination rejected record", 1)


def _responses(spark, sf_dir) -> DataFrame:
    n = F.col("event_id")
    status = F.get(F.array(*map(F.lit, [200, 404, 410, 500, 429])), (n % 5).cast("int"))
    return table(spark, sf_dir, "events").select(
        "event_id", status.alias("status"), text("user ", F.col("user_id"), ": ", F.col("event_type")).alias("body")
    )


@query("delete_missing_ok", """
    SELECT event_id, [200, 404, 410, 500, 429][event_id % 5 + 1] AS status, event_id % 5 IN (0, 1, 2) AS written FROM events
""")
def delete_missing_ok(spark, sf_dir):
    counted = writeback.count_missing_as_written(_responses(spark, sf_dir), "delete", [404, 410])
    return counted.drop("body")


RULES = [
    (429, None, "rate_limit", "slow down"), (500, "error", "bug", "report it"), (500, None, "transient", "try again"),
    (404, "user 1", "missing_user", "create it"),
]


@query("error_classify", """
    SELECT event_id, CASE status WHEN 429 THEN 'rate_limit' WHEN 500 THEN CASE WHEN event_type = 'error' THEN 'bug' ELSE 'transient' END
               WHEN 404 THEN CASE WHEN CAST(user_id AS VARCHAR) LIKE '1%' THEN 'missing_user' ELSE '' END ELSE '' END AS error_class,
           CASE status WHEN 429 THEN 'slow down' WHEN 500 THEN CASE WHEN event_type = 'error' THEN 'report it' ELSE 'try again' END
               WHEN 404 THEN CASE WHEN CAST(user_id AS VARCHAR) LIKE '1%' THEN 'create it' ELSE '' END ELSE '' END AS hint
    FROM (SELECT *, [200, 404, 410, 500, 429][event_id % 5 + 1] AS status FROM events)
""")
def error_classify(spark, sf_dir):
    return writeback.classify_errors(_responses(spark, sf_dir), RULES).drop("status", "body")
