"""Compares registered queries with their SQL on the same tables."""

from __future__ import annotations

import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else repr(round(v, 9) + 0.0)
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, int):
        return str(v)
    return str(v)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows), [columns[i] for i in order]


def compare(spark, con, name, query, folder):
    """None if equal, otherwise a text that says where they differ."""
    df = query.build(spark, folder)
    got, got_cols = _rows(df.columns, [tuple(r) for r in df.collect()])
    if not query.sql:
        return None if got else "no rows"
    cur = con.execute(query.sql)
    cols = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]) for d in cur.description}
    want, want_cols = _rows(cols, cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} vs {want_cols}"
    kinds = {
        "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean",
    }
    for c, t in df.dtypes:
        if kinds.get(types[c]) != t and types[c] != "NULL":
            print(f"   note {name}.{c}: spark {t}, duckdb {types[c]}")
    if got != want:
        only_got = sorted(set(got) - set(want))[:3]
        only_want = sorted(set(want) - set(got))[:3]
        return f"{len(got)} vs {len(want)} rows; cols {got_cols}\n   spark {only_got}\n   sql   {only_want}"
    return None if got else "equal but empty"


def main():
    from strandcheck.plans.registry import all_queries
    from strandcheck.session import build_session

    folder = sys.argv[1]
    names = sys.argv[2:]
    spark = build_session(
        master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="12g"
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name, q in all_queries().items():
        if names and not any(n in name for n in names):
            continue
        start = time.time()
        try:
            problem = compare(spark, con, name, q, folder)
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        took = time.time() - start
        print(("ok   " if problem is None else "FAIL ") + f"{name} {took:.2f}s" + (f"\n   {problem}" if problem else ""), flush=True)
        bad += problem is not None
    print("failed:", bad)


if __name__ == "__main__":
    main()
