"""Run a registered query in Spark and its SQL in DuckDB and compare the results."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def plain(value, digits):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        if digits is not None:
            value = float(f"{value:.{digits}g}")
        return int(value) if value.is_integer() and abs(value) < 2**53 else value
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v, digits) for v in value)
    return value


def rows_of(names, rows, digits):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(r[i], digits) for i in order) for r in rows]
    return [names[i] for i in order], sorted(out, key=repr)


def compare(spark, con, name, run, sql, sf):
    begin = time.time()
    df = run(spark, sf)
    got = [tuple(r) for r in df.collect()]
    spent = time.time() - begin
    if sql is None:
        return {"name": name, "sec": spent, "rows": len(got), "status": "rows-only", "exact": None}
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    want = rel.fetchall()
    exact = rows_of(df.columns, got, None) == rows_of(names, want, None)
    close = exact or rows_of(df.columns, got, 9) == rows_of(names, want, 9)
    detail = ""
    if not exact:
        a, b = rows_of(df.columns, got, 9), rows_of(names, want, 9)
        if a[0] != b[0]:
            detail = f"columns {a[0]} != {b[0]}"
        else:
            left, right = set(map(repr, a[1])), set(map(repr, b[1]))
            only_a = [x for x in a[1] if repr(x) not in right][:3]
            only_b = [x for x in b[1] if repr(x) not in left][:3]
            detail = f"{len(a[1])} vs {len(b[1])} rows; spark-only {only_a}; sql-only {only_b}"
    return {"name": name, "sec": spent, "rows": len(got), "exact": exact, "detail": detail,
            "status": "ok" if exact else "close" if close else "DIFF"}


def main(argv):
    from __spark_entry__ import oracle_sql, queries
    from hearthframe.session import build_session
    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session("compare", "local[8]", 8, spark__ui__enabled="false", spark__driver__memory="12g",
                          spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con, every, sqls = duck(sf), queries(), oracle_sql()
    names = [n for n in every if not argv or any(n.startswith(a) for a in argv)]
    bad = 0
    for name in names:
        try:
            r = compare(spark, con, name, every[name], sqls.get(name), sf)
        except Exception as error:  # noqa: BLE001
            r = {"name": name, "sec": 0, "rows": -1, "status": "ERROR", "detail": str(error)[:1500]}
        if r["status"] in ("DIFF", "ERROR"):
            bad += 1
        print(f"{r['status']:9} {r['name']:36} rows={r['rows']:<7} {r['sec']:.2f}s  "
              f"{r.get('detail', '') if r['status'] != 'ok' else ''}", flush=True)
    print(f"{len(names)} run, {bad} bad")


if __name__ == "__main__":
    main(sys.argv[1:])
