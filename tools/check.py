"""Run catalogue queries next to their DuckDB oracles and report differences.

    python tools/check.py [--sf 0.01] [--only a,b] [--module text]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

from loreweave.plans import registry
from loreweave.plans.tables import BASE, Tables, for_duckdb
from loreweave.session import local_session


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    if isinstance(v, (list, tuple)):
        return [norm(x) for x in v]
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def compare(got_cols, got, want_cols, want):
    if sorted(got_cols) != sorted(want_cols):
        return f"columns {sorted(got_cols)} != {sorted(want_cols)}"
    a, b = rows_of(got_cols, got), rows_of(want_cols, want)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}; first got {a[:2]} want {b[:2]}"
    for x, y in zip(a, b):
        if x != y or [type(i) for i in x] != [type(i) for i in y]:
            return f"row {x} != {y}"
    return None


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("--only", default="")
    ap.add_argument("--module", default="")
    ap.add_argument("--root", default="/root/testdata")
    a = ap.parse_args()
    sf_dir = f"{a.root}/sf{a.sf}"
    cat = registry.load()
    names = a.only.split(",") if a.only else list(cat)
    if a.module:
        mods = a.module.split(",")
        names = [n for n in names if cat[n].build.__module__.rsplit(".", 1)[-1] in mods]
    spark = local_session("check")
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in BASE:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    bad = 0
    total = 0.0
    for name in names:
        q = cat[name]
        t0 = time.time()
        try:
            df = q.build(Tables(spark, sf_dir))
            got = [tuple(r) for r in df.collect()]
            took = time.time() - t0
            total += took
            if q.oracle is None:
                print(f"ROWS {name} rows={len(got)} {took:.2f}s")
                continue
            t1 = time.time()
            cur = con.execute(for_duckdb(q.oracle))
            cols = [d[0] for d in cur.description]
            want = cur.fetchall()
            ot = time.time() - t1
            diff = compare(df.columns, got, cols, want)
        except Exception as e:
            diff, took, ot, got = f"{type(e).__name__}: {str(e)[:1500]}", time.time() - t0, 0, []
        if diff:
            bad += 1
            print(f"FAIL {name} {took:.2f}s {diff[:1800]}")
        else:
            flag = " EMPTY" if not got else ""
            print(f"ok   {name} rows={len(got)} {took:.2f}s oracle {ot:.2f}s{flag}")
        sys.stdout.flush()
    print(f"{len(names)} queries, {bad} bad, {total:.1f}s in Spark")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
