"""Run queries beside their check SQL: ``python tests/check_oracle.py [sf] [key prefix ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def canon(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, dict):
        return tuple(sorted((str(k), canon(v)) for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return tuple(canon(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(canon(r[i]) for i in order) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


def compare(spark, con, query, sql, folder):
    df = query(spark, folder)
    got_cols, got = df.columns, df.collect()
    res = con.execute(sql)
    want_cols, want = [d[0] for d in res.description], res.fetchall()
    if sorted(got_cols) != sorted(want_cols):
        return False, f"columns {sorted(set(got_cols) ^ set(want_cols))}", len(got)
    a, b = rows_of(got_cols, got), rows_of(want_cols, want)
    if len(a) != len(b):
        return False, f"rows {len(a)} vs {len(b)}\n   {a[:2]}\n   {b[:2]}", len(a)
    names = sorted(got_cols)
    for x, y in zip(a, b):
        for n, p, q in zip(names, x, y):
            if p != q or (type(p) is not type(q) and p is not None):
                return False, f"{n}: {p!r} vs {q!r}\n   {x}\n   {y}", len(a)
    hollow = len(a) == 0 or (len(a) == 1 and all(v in (None, 0) for v in a[0]))
    return True, "HOLLOW" if hollow else "", len(a)


def main():
    from tidewater import registry
    from tidewater.session import local_session

    args = sys.argv[1:]
    sf = args[0] if args else "0.01"
    folder = f"/root/testdata/sf{sf}"
    spark = local_session()
    con = connect(folder)
    queries, sqls = registry.queries(), registry.oracle_sql()
    bad = 0
    for name, query in queries.items():
        if args[1:] and not any(name.startswith(p) for p in args[1:]):
            continue
        start = time.time()
        try:
            if name in sqls:
                ok, why, n = compare(spark, con, query, sqls[name], folder)
            else:
                n = len(query(spark, folder).collect())
                ok, why = True, "(rows only)"
        except Exception as e:  # noqa: BLE001
            ok, why, n = False, f"{type(e).__name__}: {str(e)[:600]}", -1
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:28s} rows={n:<6d} {time.time() - start:5.1f}s {why}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
