"""Run registered queries next to their SQL and report every difference.

    python tools/compare.py [--dir /root/testdata/sf0.01] [name ...]
"""

from __future__ import annotations

import argparse
import pathlib
import sys
import time

import duckdb

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from lakesync.queries import all_oracles, all_queries  # noqa: E402
from lakesync.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def canonical(rows: list, names: list[str]) -> list[str]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([_plain(row[i]) for i in order]) for row in rows)


def _plain(value):
    if isinstance(value, float):
        return "nan" if value != value else value + 0.0
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    return value


def compare(con, frame, sql) -> str:
    rows = [tuple(r) for r in frame.collect()]
    if sql is None:
        return f"rows-only {len(rows)}"
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want = result.fetchall()
    if sorted(frame.columns) != sorted(names):
        return f"COLUMNS differ: {sorted(set(frame.columns) ^ set(names))}"
    mine, theirs = canonical(rows, frame.columns), canonical(want, names)
    if mine == theirs:
        return f"ok {len(rows)}"
    left, right = set(mine) - set(theirs), set(theirs) - set(mine)
    return (
        f"ROWS differ: {len(rows)} vs {len(want)}; columns {sorted(names)}\n"
        f"      spark: {[x[:400] for x in sorted(left)[:2]]}\n      sql:   {[x[:400] for x in sorted(right)[:2]]}"
    )


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--dir", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, oracles = connect(args.dir), all_queries(), all_oracles()
    bad = 0
    for name in args.names or queries:
        start = time.time()
        try:
            verdict = compare(con, queries[name](spark, args.dir), oracles.get(name))
        except Exception as error:
            verdict = f"ERROR {type(error).__name__}: {str(error)[:700]}"
        bad += not verdict.startswith(("ok", "rows-only"))
        print(f"{name:32} {time.time() - start:6.2f}s  {verdict}", flush=True)
    print(f"{bad} of {len(args.names or queries)} differ")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
