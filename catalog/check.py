"""Compare registered queries with their SQL twins: python -m catalog.check [sf_dir] [name ...]"""

from __future__ import annotations

import math
import sys
import time

import duckdb

from catalog import all_queries
from cuelake.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def canon(v):
    if isinstance(v, float):
        return ("f", "nan") if math.isnan(v) else ("f", repr(round(v, 6) + 0.0))
    return (type(v).__name__, repr(v))


def compare(spark, con, name, fn, sql, folder):
    t0 = time.time()
    df = fn(spark, folder)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - t0
    if sql is None:
        return "ROWS", len(rows), took, ""
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    t_sql = time.time() - t0 - took
    if sorted(cols) != sorted(df.columns):
        return "COLS", len(rows), took, f"{sorted(df.columns)} vs {sorted(cols)}"
    order = [cols.index(c) for c in df.columns]
    a = sorted(tuple(canon(v) for v in r) for r in rows)
    b = sorted(tuple(canon(r[i]) for i in order) for r in want)
    if a == b:
        return "OK", len(rows), took, f"sql {t_sql:.1f}s" if t_sql > 5 else ""
    in_a, in_b = set(a), set(b)
    only_a = [x for x in a if x not in in_b][:2]
    only_b = [x for x in b if x not in in_a][:2]
    return "DIFF", len(rows), took, f"sql rows {len(b)}\n  spark {only_a}\n  sql   {only_b}"


def main(argv):
    folder = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:]
    spark = local_session(8)
    queries, oracle = all_queries()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    bad = []
    for name, fn in queries.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        try:
            status, n, took, note = compare(spark, con, name, fn, oracle.get(name), folder)
        except Exception as error:  # keep going: report every query
            status, n, took, note = "FAIL", 0, 0.0, f"{type(error).__name__}: {str(error)[:600]}"
        if status not in ("OK", "ROWS"):
            bad.append(name)
        print(f"{status:5} {took:6.1f}s {n:8} {name} {note}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
