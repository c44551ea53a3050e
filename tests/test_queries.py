"""Every registered query against its SQL, and every plan against the rules for scale."""

import re

import pytest
from compare import compare, connect
from conftest import SMALL

from lakesync.queries import all_oracles, all_queries

QUERIES, ORACLES = all_queries(), all_oracles()

# Operators that pair all rows with all rows.
FORBIDDEN_NODES = ("CartesianProduct", "BroadcastNestedLoopJoin")
# Queries whose feature is Python code per batch.
PYTHON_QUERIES = {"record_hook_map", "redact_json_text"}


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", QUERIES)
def test_rows_and_plan(spark, con, name):
    frame = QUERIES[name](spark, SMALL)
    verdict = compare(con, frame, ORACLES.get(name))
    assert verdict.startswith(("ok", "rows-only")), verdict
    plan = plan_of(frame)
    for node in FORBIDDEN_NODES:
        assert node not in plan
    if name not in PYTHON_QUERIES:
        assert not re.search(r"ArrowEvalPython|BatchEvalPython|MapInPandas|PythonMapInArrow", plan)


def test_every_query_has_sql():
    assert sorted(QUERIES) == sorted(ORACLES)


def test_latest_per_key_limits_rows_before_the_shuffle(spark):
    plan = plan_of(QUERIES["latest_per_key"](spark, SMALL))
    below = plan[plan.index("Exchange"):]
    assert "WindowGroupLimit" in below


def test_bounds_reach_the_scan(spark):
    for name, column in (("jdbc_snapshot", "o_orderdate"), ("cursor_filter_inclusive", "ts")):
        plan = plan_of(QUERIES[name](spark, SMALL))
        pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", plan).group(1)
        assert f"GreaterThan" in pushed and column in pushed


def test_scan_reads_only_needed_columns(spark):
    plan = plan_of(QUERIES["agg_group_having"](spark, SMALL))
    assert re.search(r"ReadSchema: struct<l_orderkey:bigint>", plan)


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert all_queries().keys() == all_oracles().keys()
    # Optional parts may add to both.
    assert all_queries().keys() <= entry.queries().keys() and all_oracles().keys() <= entry.oracle_sql().keys()
    assert entry.oracle_sql().keys() <= entry.queries().keys()


def write_orders(spark, folder, rows):
    lines = ", ".join(f"({k}, {c}, {price}D, timestamp'2024-01-{day:02d}')" for k, c, price, day in rows)
    spark.sql(f"SELECT * FROM VALUES {lines} AS o(o_orderkey, o_custkey, o_totalprice, o_orderdate)").write.mode(
        "overwrite").parquet(f"{folder}/orders.parquet")


def test_levels_of_a_chain_read_steps_that_are_computed_once(spark, tmp_path, rows):
    folder = str(tmp_path)
    write_orders(spark, folder, [(1, 7, 10, 1), (2, 7, 20, 2), (3, 7, 30, 3), (4, 8, 5, 1), (5, "null", 9, 1), ("null", 8, 6, 2)])
    chain = QUERIES["sql_recursive_chain"](spark, folder)
    plan = chain._jdf.queryExecution().optimizedPlan().toString()
    assert "UnionLoop" in plan and "InMemoryRelation" in plan and "Window" not in plan
    assert rows(chain) == sorted([(7, 3, 1, 30.0), (7, 2, 2, 50.0), (7, 1, 3, 60.0), (8, 4, 1, 5.0), (8, None, 1, 6.0), (8, 4, 2, 11.0),
                                  (None, 5, 1, 9.0)], key=repr)
    # Other rows at the same place.
    write_orders(spark, folder, [(1, 7, 1, 2), (2, 7, 2, 1)])
    assert rows(QUERIES["sql_recursive_chain"](spark, folder)) == [(7, 1, 1, 1.0), (7, 2, 2, 3.0)]
