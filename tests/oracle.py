"""Run registered queries against DuckDB on the same tables; also usable from the command line:

    python tests/oracle.py [sf folder] [name part ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def cell(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (float, decimal.Decimal)):
        f = float(v)
        return "nan" if math.isnan(f) else f"{round(f, 6):.6f}"
    if isinstance(v, int):
        return str(v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return str(v)


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name, folder, queries, oracles):
    """(seconds, rows, problem or None)"""
    start = time.time()
    df = queries[name](spark, folder)
    got_names, got = table(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - start
    if name not in oracles:
        return took, len(got), None
    cur = con.execute(oracles[name])
    want_names, want = table([c[0] for c in cur.description], cur.fetchall())
    if got_names != want_names:
        return took, len(got), f"columns {got_names} != {want_names}"
    if len(got) != len(want):
        return took, len(got), f"rows {len(got)} != {len(want)}; e.g. {_diff(got, want)}"
    if got != want:
        return took, len(got), f"values differ: {_diff(got, want)}"
    return took, len(got), None


def _diff(got, want):
    g, w = set(got), set(want)
    return f"only Spark {[str(x)[:400] for x in list(g - w)[:2]]} only DuckDB {[str(x)[:400] for x in list(w - g)[:2]]}"


if __name__ == "__main__":
    from conftest import make_session

    import __spark_entry__ as entry

    args = sys.argv[1:]
    folder = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = make_session()
    con = connect(folder)
    names = [n for n in entry.queries() if not args or any(a in n for a in args)]
    bad = 0
    for n in names:
        try:
            took, rows, problem = compare(spark, con, n, folder, entry.queries(), entry.oracle_sql())
        except Exception as e:  # report and go on
            took, rows, problem = 0.0, -1, f"{type(e).__name__}: {str(e)[:1500]}"
        bad += problem is not None
        mark = "ok  " if problem is None else "FAIL"
        print(f"{mark} {n:40s} {took:6.2f}s {rows:8d} {'oracle' if n in entry.oracle_sql() else 'rows'} {problem or ''}", flush=True)
    print(f"{len(names)} queries, {bad} failed")
