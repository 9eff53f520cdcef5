"""Run registered queries in Spark and DuckDB on the same tables and compare the rows.

usage: python tools/compare.py [--sf DIR] [--show] [name ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(folder: str):
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float) and math.isnan(v):
        return None
    return v


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, folder: str, name: str, run, sql: str | None) -> tuple[bool, str]:
    start = time.time()
    df = run(spark, folder)
    got = rows_of(df.columns, df.collect())
    spent = time.time() - start
    note = f"{spent:6.1f}s {len(got):7d} rows"
    if sql is None:
        return len(got) > 0, note + "  rows only"
    start = time.time()
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    want = rows_of(columns, result.fetchall())
    note += f"  duckdb {time.time() - start:5.1f}s"
    if sorted(df.columns) != sorted(columns):
        return False, note + f"  columns {sorted(df.columns)} / {sorted(columns)}"
    if len(got) != len(want):
        return False, note + f"  {len(want)} rows expected"
    wrong = [(g, w) for g, w in zip(got, want) if g != w]
    if wrong:
        g, w = wrong[0]
        cols = sorted(df.columns)
        diff = [(c, a, b) for c, a, b in zip(cols, g, w) if a != b]
        return False, note + f"  {len(wrong)} rows differ, first: {diff[:4]} in {g[:6]}"
    return True, note


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    from weekspan.catalog import load
    from weekspan.session import local_session

    queries, oracles = load()
    spark = local_session(8)
    con = duck(args.sf)
    names = [n for n in queries if not args.names or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in args.names)]
    bad = []
    for name in names:
        try:
            ok, note = compare(spark, con, args.sf, name, queries[name], oracles.get(name))
        except Exception as e:  # report and go on
            ok, note = False, f"{type(e).__name__}: {str(e)[:600]}"
        if not ok:
            bad.append(name)
        print(f"{'ok  ' if ok else 'FAIL'} {name:32s} {note}", flush=True)
    print(f"{len(names) - len(bad)}/{len(names)} ok; failed: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
