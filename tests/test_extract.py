"""Extraction rules on small literal bodies."""

import pytest
from conftest import SPARK_ERRORS
from pyspark.sql import functions as F, types as T

from lakesync.functions.text import camel_snake, header_snake, last_path_segment, url_encode_segment
from lakesync.operators import extract


def bodies(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "body_id int, body string")


def test_records_at(spark, rows):
    frame = bodies(
        spark, '{"data":{"items":[{"id":1},2,"x",null,[{"id":9}],{"id":3}]}}', '{"data":{"items":{"id":4}}}',
        '{"data":{"items":"none"}}', '{"data":null}', '{"other":1}',
    )
    assert rows(extract.records_at(frame, "data.items", {"id": "bigint"}, ["body_id"])) == [(0, 1), (0, 3), (1, 4)]
    root = bodies(spark, '[{"id":1},{"id":2}]', '{"id":3}', "7")
    for path in ("", ".", " . "):
        assert rows(extract.records_at(root, path, {"id": "bigint"})) == [(1,), (2,), (3,)]


def test_records_keyed(spark, rows):
    frame = bodies(spark, '{"m":{"a":{"v":1,"id":"old"},"b":5,"c":{"v":2}}}', '{"m":null}', "{}")
    got = extract.records_keyed(frame, "m", {"id": "string", "v": "int"}, "id")
    assert rows(got) == [("a", 1), ("c", 2)]
    with pytest.raises(SPARK_ERRORS, match="no JSON object"):
        extract.records_keyed(bodies(spark, '{"m":[1]}'), "m", {"v": "int"}, None).collect()


def test_response_fields_win_unless_null(spark, rows):
    frame = bodies(spark, '{"page":7,"rows":[{"id":1,"page":1}]}', '{"page":null,"rows":[{"id":2,"page":2}]}')
    got = extract.merge_response_fields(frame, "rows", {"id": "int", "page": "int"}, {"page": ("page", "int")})
    assert rows(got) == [(1, 7), (2, 2)]


def test_header_rows(spark, rows):
    frame = bodies(spark, '[["ID","","Name"],["1","drop","Ada","extra"],[2],[null,null,null]]', '[["ID","Name"]]', "[]")
    assert rows(extract.header_rows(frame, ["id", "name"])) == [("", ""), ("1", "Ada"), ("2", None)]


def test_csv_body(spark, rows):
    text = 'Event Time,"User, ID",AppsFlyer ID\r\n1,"a ""q""\nb",\n\n,only\n2,x,y,surplus'
    got = rows(extract.csv_body_rows(bodies(spark, text, ""), ["event_time", "user_id", "appsflyer_id"]))
    assert got == sorted([("1", 'a "q"\nb', ""), ("", "only", None), ("2", "x", "y")], key=repr)


def test_long_csv_field(spark):
    long = "x" * 300_000 + '""' + "y\n" * 1000
    got = extract.csv_body_rows(bodies(spark, f'a,b\n"{long}",2\n'), ["a", "b"]).first()
    assert (len(got.a), got.b) == (302_001, "2")


def test_feed_without_guid(spark, rows):
    feed = "<rss><channel><item><guid> </guid><link>u</link><title>t</title></item><item><title>only</title></item></channel></rss>"
    assert rows(extract.feed_items(bodies(spark, feed)), "id") == [("only",), ("u",)]


def test_typed_collection(spark):
    xml = "<C><ROW><A> 1.5 </A><B>Yes</B></ROW><ROW><A>x</A><B></B></ROW></C>"
    got = extract.typed_collection(bodies(spark, xml), "ROW", {"a": ("A", "number"), "b": ("B", "boolean")}).collect()
    assert [(r.a, r.a_raw, r.b) for r in got][0] == (1.5, None, True)
    assert (got[1].a, got[1].a_raw) == (None, "x")


def test_queue_messages(spark):
    text = '[{"MessageId":"m","Body":"{\\"a\\": 1}","Attributes":[{"Name":"SentTimestamp","Value":"5"}]},{"MessageId":"n","Body":"plain"}]'
    got = extract.queue_messages(bodies(spark, text), ["sent_timestamp"]).collect()
    assert [(r.message_id, r.body, r.body_is_json, r.sent_timestamp) for r in got] == [
        ("m", '{"a":1}', True, "5"), ("n", "plain", False, None)
    ]


def test_unwrap(spark):
    body = '{"s":{"S":"x"},"n":{"N":"1.5"},"b":{"BOOL":false},"z":{"NULL":true},"m":{"M":{"k":{"N":"2"}}},"l":{"L":[{"S":"a"},3,{"S":"b"}]}}'
    schema = T.StructType.fromDDL("s string, n double, b boolean, z string, m struct<k:int>, l array<string>, gone string")
    row = extract.unwrap_items(bodies(spark, body), schema).first()
    assert (row.s, row.n, row.b, row.z, row.m.k, row.l, row.gone) == ("x", 1.5, False, None, 2, ["a", "b"], None)


def test_series(spark, rows):
    chart = '{"chart":{"result":[{"meta":{"symbol":"S"},"timestamp":[1,2],"indicators":{"quote":[{"open":[5]}]}}]}}'
    fields = {"open": "double", "adjclose": "double"}
    assert rows(extract.parallel_series(bodies(spark, chart), fields)) == [("S", None, 1, 5.0, None), ("S", None, 2, None, None)]
    daily = spark.createDataFrame([("X", '{"T":{"2026-01-01":{"1. open":"1"},"2026-01-02":{"1. open":"2"}}}')], "s string, body string")
    assert [r.date for r in extract.date_keyed_series(daily, "T", "s", "2026-01-01").collect()] == ["2026-01-02"]


def test_fan_out_reads_a_parent_once(spark, rows):
    parents = spark.createDataFrame([(1,), (1,), (3,)], "id int")
    landed = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c")], "parent_id string, body string")
    assert rows(extract.fan_out(parents, "id", landed, "owner"), "owner", "body") == [("1", "a"), ("3", "c")]


def test_windows(spark):
    moments = ["2026-01-01 00:00:00", "2026-01-07 23:59:59.9", "2026-01-08 00:00:00", "2026-01-10 00:00:00", "2025-12-31 23:00:00"]
    frame = spark.createDataFrame([(m,) for m in moments], "m string").select(F.to_timestamp_ntz("m").alias("at"))
    half_open = extract.time_windows(frame, "at", "2026-01-01", "2026-01-10", 7).collect()
    assert [(r.window_no, str(r.window_end)[:10]) for r in half_open] == [(0, "2026-01-08"), (0, "2026-01-08"), (1, "2026-01-10")]
    whole = extract.time_windows(frame, "at", "2026-01-01", "2026-01-10", 7, inclusive_days=True).collect()
    assert [(r.window_no, str(r.window_end)[:10]) for r in whole] == [
        (0, "2026-01-07"), (0, "2026-01-07"), (1, "2026-01-10"), (1, "2026-01-10")
    ]


@pytest.mark.parametrize("function,text,want", [
    (camel_snake, "MessageID", "message_i_d"), (camel_snake, "sent-Timestamp", "sent_timestamp"), (camel_snake, "_Foo", "foo"),
    (header_snake, " Event  Time ", "event_time"), (header_snake, "AppsFlyer-ID!", "appsflyer_id"),
    (header_snake, "Apps Flyer ID", "appsflyer_id"),
    (last_path_segment, "https://h/a/b//", "b"), (last_path_segment, "plain", "plain"), (last_path_segment, "//", ""),
    (url_encode_segment, "a b+c/é*~", "a%20b%2Bc%2F%C3%A9%2A~"),
])
def test_names(spark, function, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(function(F.col("t"))).first()[0] == want
