"""Summaries, flows and run ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lakesync.functions.values import json_quote
from lakesync.operators import ledger
from lakesync.operators.score import score
from lakesync.operators.sync import latest_per_key
from lakesync.operators.writeback import map_fields
from lakesync.plans.flows import Step, run_flow
from lakesync.queries.extraction import text
from lakesync.queries.registry import query, table
from lakesync.queries.schemas import event_records
from lakesync.queries.scoring import SPEC, contacts
from lakesync.queries.sources import RUN_AT
from lakesync.sources.tables import TableStore
from lakesync.workspace import fresh_dir


@query("table_summary", """
    SELECT 'customer' AS kind, (SELECT count(*) FROM customer) AS count, 'c_custkey,c_mktsegment,c_name,c_nationkey' AS fields,
           '[' || string_agg('{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '","c_name":"' || c_name ||
           '","c_nationkey":' || c_nationkey || '}', ',' ORDER BY c_custkey) || ']' AS sample
    FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 3)
""")
def table_summary(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").drop("c_acctbal")
    return ledger.table_summary(customers, "customer", ["c_custkey"])


@query("record_field_union", """
    SELECT field, count(*) AS n FROM (
        SELECT unnest(list_filter([CASE WHEN event_id % 11 <> 0 THEN 'id' END, 'type', 'amount', 'code', 'at', 'tags', 'meta',
            CASE WHEN event_id % 13 = 0 THEN 'extra' END], lambda x: x IS NOT NULL)) AS field FROM events)
    GROUP BY field
""")
def record_field_union(spark, sf_dir):
    return ledger.record_fields(event_records(spark, sf_dir), "record")


_COMPACT = """'{"doc_id":' || doc_id || ',"text":' || to_json(text)::VARCHAR || '}'"""
_VERBOSE = """'{' || chr(10) || '    "doc_id": ' || doc_id || ',' || chr(10) || '    "lang": ' || to_json(lang)::VARCHAR || ',' || chr(10) ||
    '    "source": ' || to_json(source)::VARCHAR || ',' || chr(10) || '    "text": ' || to_json(text)::VARCHAR || chr(10) || '}'"""


@query("token_estimate", f"""
    SELECT lang, count(*) AS rows, CAST(sum(strlen({_COMPACT}) + 1) AS BIGINT) AS compact_bytes, CAST(sum(strlen({_VERBOSE}) + 1) AS BIGINT) AS verbose_bytes,
           CAST(sum(strlen({_COMPACT}) + 1) // 4 AS BIGINT) AS compact_tokens, CAST(sum(strlen({_VERBOSE}) + 1) // 4 AS BIGINT) AS verbose_tokens
    FROM documents GROUP BY lang
""")
def token_estimate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    body, key = json_quote(F.col("text")), F.col("doc_id")
    compact = text('{"doc_id":', key, ',"text":', body, "}")
    verbose = text(
        '{\n    "doc_id": ', key, ',\n    "lang": ', json_quote(F.col("lang")), ',\n    "source": ', json_quote(F.col("source")),
        ',\n    "text": ', body, "\n}",
    )
    return ledger.token_estimate(docs, compact, verbose, by=["lang"])


@query("flow_steps_run", """
    SELECT step_id, kind, status, n AS rows FROM (VALUES
        ('land', 'sync', 'completed', (SELECT count(*) FROM customer)),
        ('rich', 'query', 'completed', (SELECT count(*) FROM customer WHERE c_acctbal > 2000)),
        ('rate', 'score', 'completed', (SELECT count(*) FROM customer WHERE c_acctbal > 2000)),
        ('push', 'action', 'completed', (SELECT count(*) FROM customer WHERE c_acctbal > 2000 AND c_custkey % 3 <> 0)),
        ('land', 'sync', 'skipped', 0), ('rich', 'query', 'skipped', 0), ('rate', 'score', 'skipped', 0), ('push', 'action', 'skipped', 0)
    ) t(step_id, kind, status, n)
""")
def flow_steps_run(spark, sf_dir):
    source = contacts(spark, sf_dir)
    steps = [
        Step("push", "action", "outbox", lambda t: map_fields(t["scored"].where(F.col("segment") != ""), {"c_custkey": "id", "_score": "score"}), ("scored",)),
        Step("rate", "score", "scored", lambda t: score(t["rich"], SPEC, RUN_AT), ("rich",)),
        Step("rich", "query", "rich", lambda t: t["contacts"].where(F.col("c_acctbal") > 2000), ("contacts",)),
        Step("land", "sync", "contacts", lambda t: source),
    ]
    store = TableStore(spark, fresh_dir(spark, "store"))
    results = run_flow(store, "leads", steps, "r1", approved=True) + run_flow(store, "leads", steps, "r1", approved=True)
    rows = [(r.step_id, r.kind, r.status, r.rows) for r in results]
    return spark.createDataFrame(rows, "step_id string, kind string, status string, rows bigint")


def run_rows(spark, sf_dir) -> DataFrame:
    """A run ledger out of the events: three writes per run id and more."""
    n = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        n.alias("seq"), text("run", n % 997).alias("id"), F.col("event_type").alias("mode"), text("op", n % 3).alias("operation"),
        F.when(n % 4 == 0, "failed").otherwise("completed").alias("status"), (n % 1000).alias("records"),
        F.col("value").alias("seconds"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"),
    )


@query("run_ledger_upsert", """
    SELECT 'run' || (event_id % 997) AS id, arg_min(event_type, event_id) AS mode, arg_min('op' || (event_id % 3), event_id) AS operation,
           arg_min(strftime(ts, '%Y-%m-%dT%H:%M:%S'), event_id) AS created_at,
           arg_max(CASE WHEN event_id % 4 = 0 THEN 'failed' ELSE 'completed' END, event_id) AS status,
           arg_max(event_id % 1000, event_id) AS records, arg_max(value, event_id) AS seconds
    FROM events GROUP BY 1
""")
def run_ledger_upsert(spark, sf_dir):
    return ledger.upsert_runs(
        run_rows(spark, sf_dir), "seq", "id", ["mode", "operation", "created_at"], ["status", "records", "seconds"]
    )


@query("run_throughput", """
    SELECT event_type AS mode, count(*) AS iterations, CAST(sum(event_id % 1000) AS BIGINT) AS records,
           CAST(sum(CAST(value AS DECIMAL(18,6))) AS DOUBLE) / count(*) AS average_seconds,
           CAST(sum(event_id % 1000) AS BIGINT) / CAST(sum(CAST(value AS DECIMAL(18,6))) AS DOUBLE) AS records_per_second
    FROM events GROUP BY event_type
""")
def run_throughput(spark, sf_dir):
    return ledger.throughput(run_rows(spark, sf_dir), "mode", "records", "seconds")


@query("ledger_open_entries", """
    WITH e AS (SELECT event_id, event_id % 1201 AS tag, event_type = 'view' AND event_id > 5000 AS cleaned, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS t, user_id FROM events),
         f AS (SELECT tag, arg_max(t, event_id) FILTER (NOT cleaned) AS planned_at, arg_max(user_id, event_id) FILTER (NOT cleaned) AS connector,
                      count(*) FILTER (cleaned) AS cleanings FROM e GROUP BY tag)
    SELECT 'tag' || tag AS tag, planned_at, connector FROM f WHERE cleanings = 0 AND planned_at <= '2024-01-28T00:00:00'
""")
def ledger_open_entries(spark, sf_dir):
    n, at = F.col("event_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    cleaned = (F.col("event_type") == "view") & (n > 5000)
    entries = table(spark, sf_dir, "events").select(
        n.alias("seq"), text("tag", n % 1201).alias("tag"), F.when(~cleaned, at).alias("planned_at"),
        F.when(cleaned, at).alias("cleaned_at"), F.col("user_id").alias("connector"),
    )
    return ledger.open_entries(entries, "tag", ["connector"], F.lit("2024-01-28T00:00:00"))


CHECKS = ["view", "click", "purchase", "other"]


@query("capability_matrix", """
    WITH r AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events),
         c AS (SELECT user_id, event_type, CASE event_id % 3 WHEN 0 THEN 'pass' WHEN 1 THEN 'fail' ELSE '' END AS result FROM r WHERE n = 1),
         w AS (SELECT user_id, coalesce(arg_max(res, action) FILTER (res NOT IN ('pass', 'skipped')), 'pass') AS write FROM (
                 SELECT user_id, printf('a%08d', event_id) AS action, CASE event_id % 20 WHEN 0 THEN 'fail' WHEN 1 THEN 'error' WHEN 2 THEN 'skipped' ELSE 'pass' END AS res
                 FROM events WHERE user_id % 2 = 0) GROUP BY user_id)
    SELECT user_id AS source, bool_or(user_id % 10 = 3) AS leaked,
           CASE WHEN user_id % 17 = 0 THEN 'skip' ELSE coalesce(max(nullif(result, '')) FILTER (event_type = 'view'), 'uncert') END AS view,
           CASE WHEN user_id % 17 = 0 THEN 'skip' ELSE coalesce(max(nullif(result, '')) FILTER (event_type = 'click'), 'uncert') END AS click,
           CASE WHEN user_id % 17 = 0 THEN 'skip' ELSE coalesce(max(nullif(result, '')) FILTER (event_type = 'purchase'), 'uncert') END AS purchase,
           CASE WHEN user_id % 17 = 0 THEN 'skip' ELSE 'uncert' END AS other,
           CASE WHEN user_id % 17 = 0 THEN '' ELSE coalesce(max(nullif(result, '')) FILTER (event_type = 'signup'), 'uncert') END AS signup,
           CASE WHEN user_id % 17 = 0 THEN 'skip' ELSE coalesce(any_value(write), 'uncert') END AS write
    FROM c LEFT JOIN w USING (user_id) GROUP BY user_id
""")
def capability_matrix(spark, sf_dir):
    events, n, user = table(spark, sf_dir, "events"), F.col("event_id"), F.col("user_id")
    first = latest_per_key(events, ["user_id", "event_type"], [-n])
    results = first.select(
        user.alias("source"), F.col("event_type").alias("check"),
        F.when(n % 3 == 0, "pass").when(n % 3 == 1, "fail").otherwise("").alias("result"),
        (user % 10 == 3).alias("leaked"), (user % 17 == 0).alias("skipped"),
    )
    actions = events.where(user % 2 == 0).select(
        user.alias("source"), F.format_string("a%08d", n).alias("action"),
        F.when(n % 20 == 0, "fail").when(n % 20 == 1, "error").when(n % 20 == 2, "skipped").otherwise("pass").alias("result"),
    )
    return ledger.capability_matrix(results, actions, "source", CHECKS, ["signup"])
