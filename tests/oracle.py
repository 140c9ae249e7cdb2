"""Compare registered queries with their SQL on the same tables."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def sql_rows(folder: str, sql: str):
    con = duckdb.connect()
    con.execute("SET threads=8")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return names, cur.fetchall()


def _key(v):
    if v is None:
        return ("0", "")
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, (int, float)):
        f = float(v)
        return ("n", "nan") if math.isnan(f) else ("n", f)
    return ("s", str(v))


def normal(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_key(r[i]) for i in order) for r in rows]
    return sorted(names), sorted(out, key=repr)


def compare(spark, entry, folder: str) -> tuple[bool, str]:
    t0 = time.time()
    df = entry.build(spark, folder)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - t0
    if entry.sql is None:
        return len(got) > 0, f"{len(got)} rows, no sql, {took:.1f}s"
    names, want = sql_rows(folder, entry.sql)
    a = normal(df.columns, got)
    b = normal(names, want)
    if a[0] != b[0]:
        return False, f"columns {a[0]} != {b[0]}"
    if len(a[1]) != len(b[1]):
        return False, f"rows {len(a[1])} != {len(b[1])}"
    bad = [(x, y) for x, y in zip(a[1], b[1]) if x != y]
    if bad:
        exact = "".join(f"\n   {[v[1] for v in x]}\n   {[v[1] for v in y]}" for x, y in bad[:3])
        return False, f"{len(bad)} of {len(a[1])} rows differ ({took:.1f}s){exact}"
    if not got:
        return False, "no rows"
    return True, f"{len(got)} rows, {took:.1f}s"


if __name__ == "__main__":
    from telemetra.plans import registry
    from telemetra.session import build_session

    folder = "/root/testdata/sf0.01"
    args = sys.argv[1:]
    if args and args[0].startswith("/"):
        folder = args.pop(0)
    spark = build_session("oracle", "local[8]", **{"spark.sql.shuffle.partitions": "8",
                          "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    fails = 0
    for name, e in registry.entries().items():
        if args and not any(a in name for a in args):
            continue
        try:
            ok, note = compare(spark, e, folder)
        except Exception as err:  # report every query
            ok, note = False, f"{type(err).__name__}: {str(err)[:1500]}"
        fails += not ok
        print("ok  " if ok else "FAIL", name, note, flush=True)
    print("failures:", fails)
