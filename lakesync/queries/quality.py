"""Data quality and redaction."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from lakesync.functions.text import redact_text
from lakesync.operators import quality
from lakesync.operators.sync import enrich
from lakesync.queries.extraction import text
from lakesync.queries.registry import query, table
from lakesync.queries.sources import RUN_AT
from lakesync.queries.syncing import marked_events, results_frame, two_runs


@query("dup_keys", """
    SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
""")
def dup_keys(spark, sf_dir):
    return quality.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("overwrite_rowcount_stable", """
    SELECT 'full_refresh_overwrite' AS mode, first_rows, last_rows, CAST(2 AS BIGINT) AS runs, first_rows = last_rows AS stable
    FROM (SELECT count(*) FILTER (ts < TIMESTAMP '2024-01-20') AS first_rows,
                 count(*) FILTER (ts >= TIMESTAMP '2024-01-10') AS last_rows FROM events)
""")
def overwrite_rowcount_stable(spark, sf_dir):
    runs = results_frame(spark, two_runs(spark, sf_dir, "full_refresh_overwrite")[1])
    runs = runs.withColumnRenamed("sync_mode", "mode")
    return quality.count_stable(runs, ["mode"], "run_id", "records_loaded")


@query("resume_check", """
    WITH r AS (SELECT user_id, count(*) FILTER (ts < TIMESTAMP '2024-01-16') AS first_read,
                      count(*) FILTER (ts >= TIMESTAMP '2024-01-16') AS second_read,
                      max(strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ')) FILTER (ts < TIMESTAMP '2024-01-16') AS first_cursor,
                      max(strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ')) FILTER (ts >= TIMESTAMP '2024-01-16') AS second_cursor
               FROM events GROUP BY user_id)
    SELECT *, coalesce(second_read <= first_read AND second_cursor >= first_cursor, false) AS resumes FROM r
""")
def resume_check(spark, sf_dir):
    # A run ledger of two runs per source (one source per user).
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    early = F.col("ts") < F.to_timestamp_ntz(F.lit("2024-01-16"))
    runs = table(spark, sf_dir, "events").groupBy("user_id", F.when(early, 1).otherwise(2).alias("seq")).agg(
        F.count("*").alias("records_read"), F.max(at).alias("cursor")
    )
    verdicts = quality.resume_verdicts(runs, ["user_id"], "seq", "records_read", "cursor")
    return verdicts.na.fill(0, ["first_read", "second_read"])


@query("strip_metadata", """
    SELECT event_id, user_id, value, event_type = 'error' AS _deleted FROM events
""")
def strip_metadata(spark, sf_dir):
    return quality.strip_metadata(enrich(marked_events(spark, sf_dir), "run1", RUN_AT, "ts").drop("ts"))


# Values a deployment would read from its vault.
SECRETS = {
    "deploy_key": "11acdfb36bb72224148e6160f674b4be45601bff", "marker": 'token = "', "mail": "@mail", "blank": " ",
    "api": 'k9 +"x"',
}


@query("secret_leak_scan", """
    SELECT doc_id, array_to_string(f, ',') AS found FROM (
        SELECT doc_id, list_filter([CASE WHEN doc_id % 50 < 6 THEN 'api' END, CASE WHEN contains(text, '11acdfb36bb72224148e6160f674b4be45601bff') THEN 'deploy_key' END,
            CASE WHEN contains(text, '@mail') THEN 'mail' END, CASE WHEN contains(text, 'token = "') THEN 'marker' END],
            lambda x: x IS NOT NULL) AS f FROM documents)
    WHERE len(f) > 0
""")
def secret_leak_scan(spark, sf_dir):
    leaks = F.array(*map(F.lit, quality.secret_forms(SECRETS["api"])))
    leak = F.coalesce(F.get(leaks, (F.col("doc_id") % 50).cast("int")), F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat("text", leak).alias("text"))
    hits = quality.scan_secrets(docs, "text", SECRETS)
    return hits.select("doc_id", F.array_join("found", ",").alias("found"))


# What must be left: the URL up to its query or fragment, no body, no values of secrets.
_BASE = "split_part(split_part(url, '?', 1), '#', 1)"


@query("redact_text", f"""
    SELECT page_id, 'GET (' || {_BASE} || '), failed: [redacted]' AS e1,
           'retry ' || {_BASE} || ' Token=[redacted]&api_key=[redacted] end' AS e2 FROM pages
""")
def redact_text_query(spark, sf_dir):
    size = F.length("html")
    pages = table(spark, sf_dir, "pages").select(
        "page_id", text("GET (", F.col("url"), '), failed: {"html": ', size, "}").alias("e1"),
        text("retry ", F.col("url"), " Token=abc", F.col("page_id"), "&api_key=k", F.col("page_id"), " end").alias("e2"),
    )
    return pages.select("page_id", redact_text(F.col("e1")).alias("e1"), redact_text(F.col("e2")).alias("e2"))


def _secret_bodies(spark, sf_dir):
    key = F.col("o_orderkey")
    body = text(
        '{"id":', key, ',"api-token":"t', key, '","owner":{"password":', F.when(key % 2 == 0, "null").otherwise('"p"'),
        ',"name":"n', F.col("o_custkey"), '"},"files":[{"download.url":"u","size":', F.col("o_custkey"), "}]}",
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", body.alias("body"))


@query("redact_json_text", """
    SELECT o_orderkey, '{"id":' || o_orderkey || ',"api-token_redacted":true,"owner":{' ||
        CASE WHEN o_orderkey % 2 = 0 THEN '"password":null' ELSE '"password_redacted":true' END ||
        ',"name":"n' || o_custkey || '"},"files":[{"download.url_redacted":true,"size":' || o_custkey || '}]}' AS body
    FROM orders
""")
def redact_json_text(spark, sf_dir):
    return _secret_bodies(spark, sf_dir).withColumn("body", quality.redact_json("body"))


@query("redact_json_fields", """
    SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE true END AS password_redacted, true AS token_redacted,
           'n' || o_custkey AS owner, '[{"download.url_redacted":true,"size":' || o_custkey || '}]' AS files
    FROM orders
""")
def redact_json_fields(spark, sf_dir):
    shape = T.StructType.fromDDL(
        "`api-token` string, owner struct<password:string,name:string>, files array<struct<`download.url`:string,size:bigint>>"
    )
    typed = _secret_bodies(spark, sf_dir).withColumn("j", F.from_json("body", shape)).select("o_orderkey", "j.*")
    return quality.redact_columns(typed).select(
        "o_orderkey", "owner.password_redacted", F.col("`api-token_redacted`").alias("token_redacted"),
        F.col("owner.name").alias("owner"), F.to_json("files").alias("files"),
    )


@query("mask_sensitive_columns", """
    SELECT '***' AS c_custkey, c_name, '***' AS api_token, c_acctbal FROM customer
""")
def mask_sensitive_columns(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.lit("t").alias("api_token"), "c_acctbal")
    return quality.mask_sensitive(customers)


@query("clean_control_chars", """
    SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text || chr(9) || 'x' ELSE text END AS clean_text, doc_id % 3 = 0 AS was_dirty,
           doc_id % 3 = 0 OR contains(text, chr(9)) OR contains(text, chr(10)) AS is_rejected
    FROM documents
""")
def clean_control_chars(spark, sf_dir):
    tail = F.lit(chr(0x200B) + "\t" + chr(0x202E) + "x")
    dirty = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("\x07"), F.col("text"), tail)).otherwise(F.col("text"))
    docs = table(spark, sf_dir, "documents").select("doc_id", dirty.alias("t"))
    return quality.clean_text(docs, "t").drop("t")
