"""Templates, conditions, schema rules, inference and drift."""

import pytest
from pyspark.sql import functions as F, types as T

from lakesync.functions.templates import compile_condition, compile_template
from lakesync.operators import schema, shape


@pytest.fixture(scope="module")
def nested(spark):
    return spark.createDataFrame(
        [(1, ("Ada", "", None), ["x", None], 1.5, True)],
        "id int, user struct<name:string,nick:string,mail:string>, tags array<string>, score double, ok boolean",
    )


@pytest.mark.parametrize("template,want", [
    ("{{ record.score }}", 1.5), ("{{ record.tags | length }}", 2), ("{{ coalesce record.user.nick record.user.mail record.id }}", "1"),
    ("{{ record.tags | join:- }}", "x-"), ("{{ record.user.name }}:{{ record.id }}", "Ada:1"), ("v{{ record.score }}", "v1.5"),
    ("{{ record.user.name | base64 | urlencode }}", "QWRh"), ("{{ record.ok }}!", "true!"), ("static", "static"),
    ("{{ config.a }}/{{ record.user.name | const:k:v }}", "A/k:v"), ("x{{ record.user.mail }}", None),
])
def test_templates(nested, template, want):
    assert nested.select(compile_template(template, nested.schema, {"a": "A"})).first()[0] == want


def test_absent_paths_add_no_column(nested):
    out = shape.computed_columns(nested, {"a": "{{ record.user.age }}", "b": "x{{ record.none.deep }}", "c": "{{ record.id | length }}"})
    assert out.columns == nested.columns


@pytest.mark.parametrize("template", [
    "{{ secrets.token }}", "{{ record.id | shout }}", "{{ config.missing }}", "{{ record.id | join:, }}", "{{ coalesce record.id }}",
    "{{ coalesce record.id config.a }}", "{{ alone }}",
])
def test_bad_templates(nested, template):
    with pytest.raises(ValueError):
        compile_template(template, nested.schema, {"a": "A"})


@pytest.mark.parametrize("condition,want", [
    ("{{ record.user.name == 'Ada' }}", True), ("record.id in ['2', '1']", True), ("record.user.nick", False),
    ("record.user.age == ''", True), ("config.gone", False), ("record.user.nick in ['']", True),
])
def test_conditions(nested, condition, want):
    assert nested.select(compile_condition(condition, nested.schema)).first()[0] is want


@pytest.mark.parametrize("condition", ["record.id != '1'", "record.id > '1'", "record.id == 1", "record.a && record.b"])
def test_bad_conditions(nested, condition):
    with pytest.raises(ValueError):
        compile_condition(condition, nested.schema)


def test_filters(spark, rows):
    frame = spark.createDataFrame([(1, None, 5.0), (2, "x", None), (3, "", 2.0)], "id int, a string, n double")
    assert rows(shape.where_absent(frame, "a"), "id") == [(1,)]
    assert rows(shape.where_equals(frame, {"n": 5}), "id") == [(1,)]
    assert rows(shape.where_equals(frame, {"n": None}), "id") == [(2,)]
    assert rows(shape.where_after_cursor(frame, "n", "2"), "id") == [(1,), (2,)]
    assert shape.project(frame, T.StructType.fromDDL("id int, z string")).columns == ["id", "z"]


@pytest.mark.parametrize("text,date", [
    ("1700000100", "2023-11-14"), ("2026-01-02", "2026-01-02"), ("2026-01-02T23:30:00-02:00", "2026-01-02"), ("2026-13-02", None), ("soon", None),
    ("2026", "1970-01-01"),
])
def test_times(spark, text, date):
    row = shape.normalize_time(spark.createDataFrame([(text,)], "t string"), "t", "date", "d").first()
    assert row.d == date and (row.d_error is None) == (date is not None)


def violation(spark, text, rules):
    frame = spark.createDataFrame([(text,)], "t string").select(F.parse_json("t").alias("r"))
    return schema.validate_rows(frame, "r", rules).first().violation


@pytest.mark.parametrize("text,rules,want", [
    ('{"a":1}', {"type": "object", "required": ["a"]}, None),
    ("{}", {"required": ["b", "a"]}, "/b: required property missing"),
    ('{"a":null}', {"required": ["a"], "properties": {"a": {"type": ["string", "null"]}}}, None),
    ('{"a":1.0}', {"properties": {"a": {"type": "integer"}}}, None),
    ('{"a":1.5}', {"properties": {"a": {"type": "integer"}}}, "/a: value does not match type ['integer']"),
    ('{"a":3}', {"properties": {"a": {"type": "number"}}}, None),
    ('{"a":"3"}', {"properties": {"a": {"type": "number"}}}, "/a: value does not match type ['number']"),
    ('{"a":{"b":[{"c":1},{"c":"x"}]}}',
     {"properties": {"a": {"properties": {"b": {"type": "array", "items": {"properties": {"c": {"type": "integer"}}}}}}}},
     "/a/b/1/c: value does not match type ['integer']"),
    ('{"b":1,"a":2,"c":3}', {"additionalProperties": False, "properties": {"b": {}}}, "/a: additional property not allowed"),
    ('{"a":1}', {"minProperties": 2}, "/: minProperties 2 not satisfied (got 1)"),
    ('{"a":"xyz"}', {"properties": {"a": {"pattern": "^x"}}}, None),
    ('{"a":"ax"}', {"properties": {"a": {"pattern": "^x"}}}, "/a: value does not match pattern"),
    ('{"a":2}', {"properties": {"a": {"enum": [1, "2", True]}}}, "/a: value not in enum"),
    ('{"a":true}', {"properties": {"a": {"enum": [1, "2", True]}}}, None),
    ('"x"', {"type": "object"}, "/: value does not match type ['object']"),
    ('[1,"a"]', {"items": {"type": "integer"}}, "/1: value does not match type ['integer']"),
])
def test_validation(spark, text, rules, want):
    assert violation(spark, text, rules) == want


def test_inference(spark):
    lines = ['{"a":null,"b":1,"c":"2026-01-01","d":[1]}', '{"a":"x","b":"late","e":{"k":1}}', '{"a":2,"b":"more","f":null,"g":1.5}']
    frame = spark.createDataFrame(list(enumerate(lines)), "n int, t string").select("n", F.parse_json("t").alias("r"))
    found = {r.field: (r.type, r.type_count, r.majority_type) for r in schema.infer_types(frame, "r", "n").collect()}
    assert found == {
        "a": ("string", 2, "string"), "b": ("integer", 2, "string"), "c": ("timestamp", 1, "timestamp"), "d": ("array", 1, "array"),
        "e": ("object", 1, "object"), "f": ("null", 0, "null"), "g": ("number", 1, "number"),
    }


def test_drift(spark):
    def frame(**fields):
        return spark.createDataFrame(list(fields.items()), "field string, type string")

    saved = frame(email="string", name="string")
    def breaking(live):
        return sorted(r.field for r in schema.schema_drift(saved, live).where("breaking").collect())

    assert breaking(frame(email="integer", name="string")) == ["email"]
    assert breaking(frame(email="string")) == ["name"]
    assert breaking(frame(email="string", name="string", age="integer")) == []
