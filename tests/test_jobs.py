"""Scoring, SQL guard, write-back, change capture, quality, flows, files and streams."""

import datetime as dt
import struct

import pytest
from conftest import SPARK_ERRORS
from pyspark.sql import functions as F

from lakesync.functions.text import redact_text
from lakesync.operators import cdc, quality, writeback
from lakesync.operators.score import Feature, ScoreSpec, rank_scored, route_requests, score, validate_scores
from lakesync.plans import sql
from lakesync.plans.flows import Step, check_flow, in_order, run_flow
from lakesync.plans.reverse import make_plan, run_plan
from lakesync.sources.readers import read_csv, read_jsonl, read_landing_dir, relational_type, snapshot
from lakesync.streaming import incremental

NOW = dt.datetime(2026, 2, 1)


# --- scoring

def test_scores(spark):
    frame = spark.createDataFrame(
        [("r2", "a@x", 10.0, 0), ("r1", "", 10.0, 3), ("r3", None, None, None), ("r0", "b@x", 99.0, 1)],
        "_sync_raw_id string, email string, visits double, flag int",
    )
    spec = ScoreSpec("s", (Feature("email", 2.0, score_if_set=1.0), Feature("visits", 1.0, score_if_gt=1.0, threshold=50.0, default=0.5),
                           Feature("flag", 1.0, score_if_set=0.4), Feature("gone", 0.0, score_if_set=1.0)))
    ranked = {r._sync_raw_id: (r._score, r._score_rank) for r in rank_scored(score(frame, spec, "t")).collect()}
    assert ranked == {"r0": (3.4 / 4, 1), "r2": (2.5 / 4, 2), "r1": ((0.0 + 0.5 + 0.4) / 4, 3), "r3": (0.5 / 4, 4)}


def test_bad_specs():
    for spec in (ScoreSpec("", (Feature("a", 1.0),)), ScoreSpec("s", ()), ScoreSpec("s", (Feature("a", -1.0),)),
                 ScoreSpec("s", (Feature("a", 1.0, score_if_gt=1.0),))):
        with pytest.raises(ValueError):
            spec.check()


def test_validation_of_scores(spark):
    source = spark.createDataFrame([("a",), ("b",)], "_sync_raw_id string")

    def failures(*scored):
        result = spark.createDataFrame(list(scored), "_sync_raw_id string, _score double")
        return {r.chk for r in validate_scores(source, result).collect() if not r.passed}

    assert failures(("a", 0.1), ("b", 0.9)) == set()
    assert failures(("a", 0.5), ("b", 0.5)) == {"dist.not_degenerate"}
    assert "score.range" in failures(("a", float("nan")), ("b", 0.5))
    assert "score.range" in failures(("a", None), ("b", 0.5))
    assert failures() >= {"result.rowcount", "card.equality", "ref.coverage", "dist.not_degenerate"}
    missing = validate_scores(source, source).collect()
    assert [(r.chk, r.passed) for r in missing] == [("schema.required", False)]


def test_routes(spark):
    frame = spark.createDataFrame([("Predict churn",), ("show the trend",), ("list users",)], "t string")
    got = [(r.task, r.confidence, r.key_indicators) for r in route_requests(frame, "t").collect()]
    assert got == [("ml", 0.6, ["predict", "churn"]), ("data_analysis", 0.55, ["trend"]), ("simple_query", 0.5, [])]


# --- SQL

@pytest.mark.parametrize("text", [
    "", "  -- nothing", "INSERT INTO t VALUES (1)", "DROP VIEW v", "select 1; drop table t", "with x as (select 1) delete from x",
    "EXPLAIN SELECT 1", "SET x = 1", "FROM t INSERT INTO u SELECT 1", "select 1) AS a; drop view v; select (1", "CREATE TABLE t AS SELECT 1",
    "SELECT reflect('java.lang.System', 'lineSeparator')", "SELECT `java_method` /* */ ('java.lang.System', 'lineSeparator')",
])
def test_refused(spark, text):
    with pytest.raises(ValueError):
        sql.query(spark, text)


@pytest.mark.parametrize("text", ["SELECT * FROM text.`/etc/hostname`", "SELECT * FROM (SELECT * FROM parquet.`/tmp/none`)"])
def test_files_are_not_read_by_path(spark, text):
    with pytest.raises(SPARK_ERRORS):
        sql.query(spark, text).collect()
    assert spark.conf.get("spark.sql.runSQLOnFiles") == "true"


def test_names_and_literals_do_not_matter(spark):
    spark.createDataFrame([(k, "drop; limit 3") for k in range(30)], "`set` int, load string").createOrReplaceTempView("odd_names")
    assert sql.query(spark, "SELECT `set`, load FROM odd_names WHERE load LIKE '%limit 3%' -- limit 2", 10).count() == 10
    assert sql.query(spark, "SELECT set, ';' AS semi FROM odd_names LIMIT 12", 10).count() == 12
    assert sql.query(spark, "WITH x AS (SELECT max(set) AS m FROM odd_names) SELECT m FROM x").first().m == 29


@pytest.mark.parametrize("text,want", [
    ("select 1 limit 5", True), ("select * from (select 1 limit 5)", False), ("select limits from t", False),
    ("select f(g(1), (2)) from t LIMIT 1", True), ("select 'limit 5' as x", False), ("select 1 -- limit 5", False),
    ("select `limit 5`, t.limit from t", False),
])
def test_top_level_limit(text, want):
    assert sql.has_top_level_limit(text) is want


def test_join_over_views(spark, store):
    store.append("customers", "r1", spark.createDataFrame([("c1", "Ada"), ("c2", "Grace")], "customer_id string, name string"))
    store.append("sales", "r2", spark.createDataFrame([("o1", "c1", 100), ("o2", "c1", 50), ("o3", "c2", 70)], "id string, customer_id string, amount int"))
    assert sql.register_views(store) == ["customers", "sales"]
    got = sql.query(spark, "SELECT name, sum(amount) AS total FROM sales JOIN customers USING (customer_id) GROUP BY name ORDER BY total DESC", 10)
    assert [tuple(r) for r in got.collect()] == [("Ada", 150), ("Grace", 70)]


# --- write-back

def contacts(spark, *rows):
    return spark.createDataFrame(list(rows), "n int, email string, name string")


def test_last_write_wins(spark, rows):
    frame = contacts(spark, (1, "alice", "v1"), (2, "bob", "x"), (3, "alice", "v2"), (4, None, "p"), (5, None, "q"))
    assert rows(writeback.dedupe_actions(frame, "n"), "n") == [(2,), (3,), (4,), (5,)]


def plan_of(frame, **more):
    return make_plan(frame, "p1", "contacts", "", {"email": "mail", "name": "name"}, {"to": "crm"}, "token", NOW, **more)


def test_plan_runs_once(spark):
    frame, saved = contacts(spark, (1, "a", "x"), (2, "b", "y")), []
    plan = plan_of(frame)
    with pytest.raises(ValueError, match="not the approval token"):
        run_plan(plan, frame, "guess", NOW, list, saved.append)
    with pytest.raises(ValueError, match="approved until"):
        run_plan(plan, frame, "token", NOW + dt.timedelta(hours=25), list, saved.append)
    done = run_plan(plan, frame.orderBy("name", ascending=False), "token", NOW, list, saved.append)
    assert [p.status for p in saved] == ["executing", "executed"] and done.token_hash is None
    with pytest.raises(ValueError, match="it is executed"):
        run_plan(done, frame, "token", NOW, list, saved.append)


def test_destructive_plans_need_a_typed_word(spark):
    frame, saved, sent = contacts(spark, (1, "a", "x")), [], []
    plan = make_plan(frame, "p1", "contacts", "delete", {"email": "mail"}, {"to": "crm"}, "token", NOW)
    assert plan.challenge == "destructive" and plan_of(frame).challenge == ""
    for typed in ("", "yes", "Destructive"):
        with pytest.raises(ValueError, match="needs the confirmation"):
            run_plan(plan, frame, "token", NOW, sent.append, saved.append, typed)
    assert not saved and not sent
    assert run_plan(plan, frame, "token", NOW, list, saved.append, " destructive ").status == "executed"
    own = plan_of(frame, challenge="crm")
    with pytest.raises(ValueError, match="'crm'"):
        run_plan(own, frame, "token", NOW, list, saved.append)


def test_changed_rows_invalidate(spark):
    saved, plan = [], plan_of(contacts(spark, (1, "a", "x"), (1, "a", "x")))
    with pytest.raises(ValueError, match="not those the plan"):
        run_plan(plan, contacts(spark, (1, "a", "x")), "token", NOW, list, saved.append)
    assert [p.status for p in saved] == ["invalidated"]
    with pytest.raises(ValueError, match="more than the limit"):
        plan_of(contacts(spark, (1, "a", "x"), (2, "b", "y")), max_rows=1)


def test_failed_write_is_recorded(spark):
    frame, saved = contacts(spark, (1, "a", "x")), []

    def sink(rows):
        raise RuntimeError("refused")

    with pytest.raises(SPARK_ERRORS):
        run_plan(plan_of(frame), frame, "token", NOW, sink, saved.append)
    assert [p.status for p in saved] == ["executing", "failed"]


def test_record_ids_tell_null_from_text(spark):
    frame = contacts(spark, (1, None, "a"), (1, "null", "a"), (1, "", "a"))
    ids = {r[0] for r in frame.select(writeback.record_id(frame.schema, frame.columns, "f", "s")).collect()}
    assert len(ids) == 3


def test_outcomes(spark, rows):
    sent = spark.createDataFrame([("a",), ("b",), ("c",)], "record_id string")
    answers = spark.createDataFrame([("a", True, None), ("b", False, "ext")], "record_id string, failed boolean, external_id string")
    got = rows(writeback.delivery_outcomes(sent, answers), "record_id", "outcome", "mapped_id")
    assert got == [("a", "dead_letter", None), ("b", "succeeded", "ext"), ("c", "succeeded", "c")]


# --- change capture

def text_cell(value):
    if value is None:
        return b"n"
    return b"u" if value == "unchanged" else b"t" + struct.pack(">i", len(value)) + value.encode()


def change(tag, cells, marker=b"N", old=None, relation=42):
    head = tag + struct.pack(">I", relation)
    if old is not None:
        head += b"K" + struct.pack(">H", len(old)) + b"".join(map(text_cell, old))
    return head + marker + struct.pack(">H", len(cells)) + b"".join(map(text_cell, cells))


def decoded(spark, *messages):
    frame = spark.createDataFrame([(i, bytearray(m)) for i, m in enumerate(messages)], "position bigint, m binary")
    relation = spark.createDataFrame(
        [(42, -1, [("id", 23), ("email", 25), ("active", 16), ("score", 1700)])],
        "relation_id bigint, position bigint, columns array<struct<name:string,type_id:int>>",
    )
    bound = cdc.bind_relations(cdc.decode_messages(frame, "m", ["position"]), relation, ["columns"])
    return cdc.cdc_events(bound, {"id": "int", "email": "text", "active": "bool", "score": "float"}, ["position", "op"])


def test_change_messages(spark):
    events = decoded(
        spark, b"B", change(b"I", ["7", "ada", "t", "98.5"]), change(b"U", ["7", "grace", "f", "99.25"], old=["7"]),
        change(b"U", ["7", "unchanged", None, "1"]), change(b"D", ["7"], marker=b"K"), b"C",
    ).orderBy("position").collect()
    assert [(e.op, e.id, e.email, e.active, e.score) for e in events] == [
        ("insert", 7, "ada", True, 98.5), ("update", 7, "grace", False, 99.25), ("update", 7, None, None, 1.0), ("delete", 7, None, None, None),
    ]
    assert [(e.email_set, e.active_set, e.score_set) for e in events[2:]] == [(False, True, True), (False, False, False)]


@pytest.mark.parametrize("message", [b"X123456", change(b"I", ["7"], marker=b"K"), change(b"I", ["7"]) + b"\x00", change(b"I", ["7"], relation=9)])
def test_bad_messages(spark, message):
    with pytest.raises(SPARK_ERRORS):
        decoded(spark, message).collect()


def test_apply_changes(spark, rows):
    log = [(1, 1, "insert", "a", True), (1, 2, "update", None, False), (2, 3, "insert", "b", True), (2, 4, "update", None, True),
           (3, 5, "insert", "c", True), (3, 6, "delete", None, True), (4, 7, "insert", "d", True), (4, 8, "delete", None, True),
           (4, 9, "update", None, False), (1, 10, "update", None, False), (1, 11, "update", None, False)]
    frame = spark.createDataFrame(log, "k int, at bigint, op string, v string, v_set boolean")
    got = rows(cdc.apply_changes(frame, ["k"], ["v"], "at"), "k", "v")
    assert got == [(1, "a"), (2, None), (4, None)]


def test_log_positions_are_numbers(spark):
    frame = spark.createDataFrame([("0/16B6C50",), ("A/1",), ("9/FFFFFFFF",)], "l string")
    order = [r.l for r in frame.orderBy(cdc.lsn_position(F.col("l"))).collect()]
    assert order == ["0/16B6C50", "9/FFFFFFFF", "A/1"]


# --- quality

@pytest.mark.parametrize("text,want", [
    ("see https://h.example/p?token=1#x), then", "see https://h.example/p), then"), ("https://h.example/p", "https://h.example/p"),
    ('failed: {"a": 1}', "failed: [redacted]"), ('failed: {"a": 1} later', 'failed: {"a": 1} later'),
    ("API-KEY=abc&x=1 password=p", "API-KEY=[redacted]&x=1 password=[redacted]"), ("http:///p?q=1", "http:///p?q=1"),
])
def test_redaction(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(redact_text(F.col("t"))).first()[0] == want


def test_json_redaction(spark):
    text = '{"Download URL":"u","body":null,"n":[{"accessToken":1,"ok":{"raw":2}}]}'
    got = spark.createDataFrame([(text,), (None,)], "t string").select(quality.redact_json("t")).collect()
    assert [r[0] for r in got] == ['{"Download URL_redacted":true,"body":null,"n":[{"accessToken_redacted":true,"ok":{"raw_redacted":true}}]}', None]


def test_clean(spark):
    row = quality.clean_text(spark.createDataFrame([("a\x00b" + chr(0x200B) + "\tc\n" + chr(0x85),)], "t string"), "t").first()
    assert (row.clean_text, row.was_dirty, row.is_rejected) == ("ab\tc\n", True, True)


# --- flows

def step(name, inputs=(), make=None, kind="query"):
    return Step(name, kind, f"t_{name}", make or (lambda t: list(t.values())[0]), tuple(f"t_{i}" for i in inputs))


def test_flow_order_and_rules():
    assert [s.step_id for s in in_order([step("c", ["b"]), step("b", ["a"]), step("a")])] == ["a", "b", "c"]
    with pytest.raises(ValueError, match="cycle"):
        in_order([step("a", ["b"]), step("b", ["a"])])
    for name, steps in (("bad name", [step("a")]), ("f", [step("a"), step("a")]), ("f", [step("a", ["z"])]), ("f", [step("a", kind="x")])):
        with pytest.raises(ValueError):
            check_flow(name, steps)


def test_flow_resumes_after_failure(spark, store):
    failing = [True]

    def second(tables):
        value = F.raise_error(F.lit("x")).cast("bigint") if failing[0] else F.col("id") + 1
        return tables["t_a"].select(value.alias("id"))

    steps = [step("a", make=lambda t: spark.range(3), kind="sync"), step("b", ["a"], second), step("c", ["b"])]
    assert [r.status for r in run_flow(store, "f", steps, "r1")] == ["completed", "failed"]
    failing[0] = False
    assert [(r.status, r.rows) for r in run_flow(store, "f", steps, "r1")] == [("skipped", 0), ("completed", 3), ("completed", 3)]


# --- files

def test_jsonl_lines(spark, tmp_path, rows):
    (tmp_path / "a.jsonl").write_text('{"id":1}\n\n   \n{"id":2}\n')
    assert rows(read_jsonl(spark, str(tmp_path), "id int")) == [(1,), (2,)]
    (tmp_path / "b.jsonl").write_text('{"id":')
    with pytest.raises(SPARK_ERRORS):
        read_jsonl(spark, str(tmp_path), "id int").collect()


def test_ragged_csv_fails(spark, tmp_path, rows):
    (tmp_path / "a.csv").write_text('id,note\n1,"x, ""y""\nz"\n2,\n')
    assert rows(read_csv(spark, str(tmp_path), ["id", "note"])) == [("1", 'x, "y"\nz'), ("2", "")]
    (tmp_path / "a.csv").write_text("id,note\n1\n")
    with pytest.raises(SPARK_ERRORS):
        read_csv(spark, str(tmp_path), ["id", "note"]).collect()


def test_landing_dir_tells_files_by_name(spark, tmp_path, rows):
    (tmp_path / "a.CSV").write_text("id,n\n1,x\n")
    (tmp_path / "b.csv").write_text("id,n\n2,y\n")
    for i, name in enumerate(["c.jsonl", "d", "csv", "e.csvx", "f.tsv", "acsv", "v"]):
        (tmp_path / name).write_text('{"id":%d,"n":"j"}\n' % (i + 10))
    got = rows(read_landing_dir(spark, str(tmp_path), ["id", "n"]))
    assert got == sorted([("1", "x"), ("2", "y")] + [(str(i + 10), "j") for i in range(7)], key=repr)


def test_snapshot_bound_is_exclusive(spark):
    frame = spark.createDataFrame([(1000,), (2000,), (3000,)], "updated int")
    assert [r.updated for r in snapshot(frame, "updated", "1000").collect()] == [2000, 3000]
    assert snapshot(frame, "updated", "1000", limit=1).first().updated == 2000
    with pytest.raises(ValueError):
        snapshot(frame, 'updated"; drop', "1")


def test_relational_types(spark):
    frame = spark.createDataFrame([("bigserial",), ("money",), ("jsonb",), ("uuid",), ("ARRAY",)], "t string")
    assert [r[0] for r in frame.select(relational_type(F.col("t"))).collect()] == ["integer", "number", "object", "string", "array"]


# --- streams

def test_stream_goes_on_where_it_stopped(spark, tmp_path, rows):
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    frame = spark.createDataFrame([(1, 1, False), (2, 2, False)], "k int, at int, gone boolean")
    frame.coalesce(1).write.parquet(source)

    def run():
        stream = incremental.file_stream(spark, source, frame.schema, max_files=1)
        return incremental.incremental_deduped(stream, target, checkpoint, ["k"], ["at"], F.col("gone"))

    assert rows(run(), "k", "at") == [(1, 1), (2, 2)]
    spark.createDataFrame([(1, 5, False), (2, 3, True), (3, 1, False)], frame.schema).coalesce(1).write.mode("append").parquet(source)
    assert rows(run(), "k", "at") == [(1, 5), (3, 1)]
    assert rows(run(), "k", "at") == [(1, 5), (3, 1)]


def test_failed_batch_is_replaced(spark, tmp_path, rows):
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    frame = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    frame.write.parquet(source)

    def run(accept):
        return incremental.incremental_append(incremental.file_stream(spark, source, frame.schema), target, checkpoint, accept)

    with pytest.raises(Exception):
        run(F.when(F.col("k") == 2, F.raise_error(F.lit("x"))).otherwise(True).cast("boolean"))
    assert rows(run(F.lit(True))) == [(1, "a"), (2, "b")]


def test_secret_forms(spark):
    secret = 'k9 +"<x>'
    texts = [
        secret, "azkgKyI8eD4=", "..azkgKyI8eD4..", "k9+%2B%22%3Cx%3E", "k9%20+%22%3Cx%3E", 'k9 +\\"\\u003cx\\u003e', "k9 +x", " "
    ]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = quality.scan_secrets(frame, "t", {"key": secret, "blank": " "})
    assert sorted(r.i for r in found.collect()) == [0, 1, 2, 3, 4, 5]
    assert quality.scan_secrets(frame, "t", {}).count() == 0


def test_flow_gates(spark, store):
    steps = [step("a", make=lambda t: spark.range(3), kind="sync"), step("b", ["a"], kind="action")]
    assert [(r.step_id, r.status) for r in run_flow(store, "f", steps, "r1", dry_run=True)] == [("a", "dry_run"), ("b", "dry_run")]
    with pytest.raises(PermissionError):
        run_flow(store, "f", steps, "r1")
    assert store.names() == []
    for force in (False, True):
        assert [r.status for r in run_flow(store, "f", steps, "r1", approved=True, force=force)] == ["completed", "completed"]


def test_resume_verdicts_compare_cursors_by_kind(spark):
    runs = spark.createDataFrame(
        [("s", 1, 5, "9"), ("s", 2, 5, "10"), ("t", 1, 5, "10"), ("t", 2, 1, "9"), ("u", 1, 1, "1"), ("u", 2, 2, "2")],
        "source string, seq int, n int, cursor string",
    )
    verdicts = quality.resume_verdicts(runs, ["source"], "seq", "n", "cursor", "number").collect()
    assert {r.source: r.resumes for r in verdicts} == {"s": True, "t": False, "u": False}
