"""Run registered queries next to their checking SQL: ``python -m tests.compare [prefix ...] [--sf 0.01]``."""

from __future__ import annotations

import argparse
import sys
import time

import duckdb

import __spark_entry__ as entry_module
from weirspan.bindings import DRIVER_TABLES
from weirspan.session import local_session

DATA = "/root/testdata/sf{}"


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{DATA.format(sf)}/{name}.parquet')")
    return con


def canonical(names: list[str], rows: list[tuple]) -> list[tuple[str, ...]]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple("NULL" if row[i] is None else repr(row[i]) for i in order) for row in rows)


def compare(spark, con, name: str, sf: str) -> str:
    """Empty when both sides agree, else a short description of the difference."""
    df = entry_module.queries()[name](spark, DATA.format(sf))
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    sql = entry_module.oracle_sql().get(name)
    if sql is None:
        return "" if got else "no rows"
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    want = canonical(columns, cur.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    if not got:
        return "both sides empty" if not want else f"no rows, expected {len(want)}"
    if got == want:
        return ""
    have, expected = set(got), set(want)
    extra = [g for g in got if g not in expected][:3]
    lacking = [w for w in want if w not in have][:3]
    n = sum(a != b for a, b in zip(got, want))
    return f"rows {len(got)} vs {len(want)}, {n} differ; columns {sorted(columns)}\n   spark {extra}\n   check {lacking}"


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("prefix", nargs="*")
    parser.add_argument("--sf", default="0.01")
    args = parser.parse_args()
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = duck(args.sf), 0
    for name in entry_module.queries():
        if args.prefix and not any(name.startswith(p) for p in args.prefix):
            continue
        t0 = time.time()
        try:
            problem = compare(spark, con, name, args.sf)
        except Exception as e:  # keep going, report at the end
            problem = f"{type(e).__name__}: {str(e)[:900]}"
        checked = "" if name in entry_module.oracle_sql() else " (rows only)"
        sys.stderr.flush()
        print(f"\n{'ok  ' if not problem else 'FAIL'} {name}{checked} {time.time() - t0:.1f}s {problem}", flush=True)
        bad += bool(problem)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(min(main(), 1))
