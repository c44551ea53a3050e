"""Hooks for sources and writers, schema mapping, and types found in the data."""

import json
from collections.abc import Iterator

import pytest
from conftest import SPARK_ERRORS
from pyspark.sql import functions as F, types as T

from lakesync.operators import mapping
from lakesync.plans.sync_run import run_sync
from lakesync.operators.sync import StreamSpec
from lakesync.sources.hooks import Bound, LandedBodies, PayloadFiles, StreamHook, read_hook, read_payloads, write_hook


def numbers(forbidden):
    """Slices of ten numbers; bounds on ``slice`` are taken care of, and slices that should not be asked for fail.  The class
    stands in here so that it travels to the workers."""
    class Numbers(StreamHook):
        def schema(self, options):
            return T.StructType([T.StructField("slice", T.LongType()), T.StructField("n", T.LongType())])

        def takes(self, bound, options):
            return bound.column == "slice"

        def slices(self, options, bounds):
            return [k for k in range(int(options["slices"])) if all(b.holds(k) for b in bounds)]

        def read(self, options, part) -> Iterator[tuple]:
            if part in forbidden:
                raise ValueError(f"slice {part} was read")
            yield from ((part, 10 * part + k) for k in range(10))

    return Numbers()


def test_bounds_leave_out_slices(spark):
    hook = numbers({0, 1, 9})
    read = lambda *bounds: read_hook(spark, "numbers", hook, bounds, slices="10")
    picked = read(Bound("slice", ">=", 2), Bound("slice", "<", 9), Bound("n", "<=", 40))
    assert picked.rdd.getNumPartitions() == 7
    assert sorted(r.n for r in picked.collect()) == list(range(20, 41))
    assert {r.slice for r in read(Bound("slice", "in", (3, 5))).collect()} == {3, 5}
    with pytest.raises(SPARK_ERRORS):
        read(Bound("n", ">", 25)).collect()  # not on slices
    both = read(Bound("slice", "=", 2)).unionByName(read(Bound("slice", "=", 3)))
    assert {r.slice for r in both.collect()} == {2, 3}


@pytest.mark.parametrize(("operator", "value", "holds"), [("=", 3, [3]), (">", 3, [4, 5]), (">=", 3, [3, 4, 5]), ("<", 3, [1, 2]), ("<=", 3, [1, 2, 3]), ("in", (1, 5), [1, 5])])
def test_bounds(operator, value, holds):
    assert [v for v in (1, 2, 3, 4, 5, None) if Bound("c", operator, value).holds(v)] == holds


def test_files_are_read_in_ranges_of_bytes(spark, tmp_path):
    """Every line is read once, whatever the ranges, with long lines, blank lines and other line ends."""
    lines = {}
    for year in (1, 2, 3):
        folder = tmp_path / f"year={year}"
        folder.mkdir()
        lines[year] = [f"{year}:{k}:" + "é" * (k * 7 % 20) for k in range(5)] + ["x" * 90]
        (folder / "a.txt").write_bytes("\n".join(lines[year]).encode() + b"\n\n")
        (folder / "b.txt").write_bytes(b"")
        (folder / "_SUCCESS").write_bytes(b"no body")
    (tmp_path / "year=2" / "c.txt").write_bytes("win\r\n".encode() * 3)
    lines[2] += ["win"] * 3
    for size in (5, 64, 10_000):
        read = read_hook(spark, "landed", LandedBodies(("year",), slice_bytes=size), [Bound("year", ">=", 2)], path=str(tmp_path))
        got = sorted((r.year, r.body) for r in read.collect())
        assert got == sorted((y, line) for y in (2, 3) for line in lines[y])
    assert read.select("slices").distinct().collect()[0].slices == 3
    hook = LandedBodies(("year",), slice_bytes=1)
    parts = hook.slices({"path": str(tmp_path)}, [Bound("year", "=", 3)])
    bodies = [b for part in parts for batch in hook.read({"path": str(tmp_path)}, part) for b in batch.column(0).to_pylist()]
    assert bodies == lines[3]


# --- writers

def payloads(spark, n, tag="p"):
    return spark.range(n).select(F.format_string(tag + "%05d", "id").alias("payload")).repartition(5)


def test_a_run_is_handed_over_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path)
    write_hook(payloads(spark, 100), "payload_files", PayloadFiles(), path=path, run="a")
    with pytest.raises(SPARK_ERRORS):
        write_hook(payloads(spark, 100), "payload_files", PayloadFiles(refuse="p00050"), path=path, run="b")
    assert read_payloads(spark, path, "a").count() == 100
    assert read_payloads(spark, path, "b").count() == 0 and not list((tmp_path / "staged" / "b").iterdir())
    # A second hand-over of the same run is refused and changes nothing.
    with pytest.raises(SPARK_ERRORS):
        write_hook(payloads(spark, 100, "q"), "payload_files", PayloadFiles(), path=path, run="a")
    assert {r.payload[0] for r in read_payloads(spark, path, "a").collect()} == {"p"}
    listed = json.loads((tmp_path / "published" / "a.json").read_text())
    assert sorted(p.name for p in (tmp_path / "staged" / "a").iterdir()) == sorted(e["path"].rpartition("/")[2] for e in listed)


def test_attempts_that_ran_twice_are_handed_over_once(tmp_path):
    """Two attempts of one task stage the same rows; the driver hears of one."""
    import pyarrow as pa

    hook, options = PayloadFiles(), {"path": str(tmp_path), "run": "r"}
    batch = lambda: iter([pa.RecordBatch.from_pydict({"payload": ["one", "two"]})])
    lost = hook.stage(options, "attempt0", batch())
    kept = hook.stage(options, "attempt1", batch())
    hook.publish(options, [kept])
    assert [e["path"] for e in hook.listed(str(tmp_path), "r")] == [kept.details["path"]]
    assert not (tmp_path / "staged" / "r" / f"{lost.attempt}.txt").exists()
    assert (tmp_path / "staged" / "r" / "attempt1.txt").read_text() == "one\ntwo\n"


# --- schema mapping

def test_mapped_columns(spark, rows):
    frame = spark.sql("SELECT 1 AS a, named_struct('x', 2, 'y', '3') AS s, array(named_struct('x', 4, 'y', '5')) AS l, 7 AS `odd.name`")
    mapper = mapping.in_turn(
        mapping.renamed({"a": "b", "odd.name": "plain"}), mapping.retyped({T.IntegerType: T.StringType()}), mapping.renamed({"b": "c"}),
        lambda s: T.StructType([*s.fields, T.StructField("none", T.DoubleType())]))
    out = mapping.map_schema(frame, mapper)
    assert out.columns == ["c", "s", "l", "plain", "none"]
    row = out.first()
    assert (row.c, row.s.x, row.s.y, row.l[0].x, row.plain, row.none) == ("1", "2", "3", "4", "7", None)
    with pytest.raises(ValueError, match="stands twice"):
        mapping.map_schema(frame, mapping.renamed({"a": "s"}))


def test_a_run_lands_mapped_columns(spark, store):
    frame = spark.createDataFrame([(1, "x"), (2, "y")], "ID int, Value string")
    run_sync(store, frame, StreamSpec("t", ("id",), "id"), "incremental_append_deduped", "run1", "2024-01-01T00:00:00Z", mapper=mapping.renamed({"ID": "id", "Value": "value"}))
    assert sorted((r.id, r.value) for r in store.read("t").collect()) == [(1, "x"), (2, "y")]


def items(spark, *bodies):
    return spark.createDataFrame([(k, b if b is None else json.dumps(b)) for k, b in enumerate(bodies)], "k int, body string")


def test_items_of_unknown_shape(spark):
    deep = {"M": {"l": {"L": [{"L": [{"N": "1"}, {"N": "2"}]}, {"L": []}]}, "a.b": {"S": "dot"}, 'q"': {"S": "quote"}, "both\"'": {"S": "both"}}}
    got = mapping.unwrap_found(items(
        spark,
        {"s": {"S": "x"}, "n": {"N": "1.50"}, "b": {"B": "aGk="}, "flag": {"BOOL": False}, "nil": {"NULL": True}, "deep": deep},
        {"s": {"NULL": True}, "only": {"S": "here"}, "mixed": {"S": "text"}, "set": {"SS": ["p", "q"]}, "l": {"L": [{"S": "a"}, 5, {"M": {"z": {"S": "1"}}}]}},
        {"mixed": {"M": {"k": {"BOOL": True}}}, "deep": 7, "l": {"L": [{"N": "3"}]}},
        {"mixed": {"BOOL": True}, "deep": {"M": {"l": {"L": [{"L": [{"N": "9"}]}, 8]}, "no": 1}}},
        None, {},
    ), ("k",))
    rows = {r.k: r for r in got.collect()}
    assert (rows[0].s, rows[0].n, rows[0].b, rows[0].flag, rows[0].nil) == ("x", "1.50", "aGk=", False, None)
    assert rows[0].deep.l == [["1", "2"], []] and rows[0].deep["a.b"] == "dot" and rows[0].deep['q"'] == "quote" and rows[0].deep["both\"'"] == "both"
    assert rows[1].s is None and rows[1].only == "here" and rows[0].only is None
    assert [rows[k].mixed for k in (1, 2, 3)] == ["text", '{"k":true}', "true"]
    assert rows[1].set == '["p","q"]'
    assert rows[1].l == ["a", '{"z":"1"}'] and rows[2].l == ["3"]
    assert rows[2].deep is None and rows[3].deep.l == [["9"]] and "no" not in got.schema["deep"].dataType.names
    assert all(v is None for k in (4, 5) for c, v in rows[k].asDict().items() if c != "k")


def test_no_items(spark):
    with pytest.raises(ValueError, match="no body"):
        mapping.unwrap_found(items(spark, None, 5))
