"""Run registered queries against DuckDB: ``python -m tests.compare [--sf 0.01] [name ...]``."""

from __future__ import annotations

import argparse
import decimal
import math
import os
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()
DATA = os.environ.get("TIDYMILL_DATA", "/root/testdata")


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _value(v: object) -> object:
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float) and math.isnan(v):
        return None
    return v


def _rows(names: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_value(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, fn, sql: str, folder: str) -> str | None:
    """None when both engines agree, else what differs."""
    df = fn(spark, folder)
    got_names, got = df.columns, [tuple(r) for r in df.collect()]
    cursor = con.execute(sql)
    want_names = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    if sorted(got_names) != sorted(want_names):
        return f"columns {sorted(got_names)} != {sorted(want_names)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    a, b = _rows(got_names, got), _rows(want_names, want)
    types = [{type(v) for v in col if v is not None} for col in zip(*a)], [
        {type(v) for v in col if v is not None} for col in zip(*b)
    ]
    if a != b:
        left, right = set(a) - set(b), set(b) - set(a)
        return f"{len(left)}/{len(a)} rows differ {sorted(got_names)}\n   spark {sorted(left, key=repr)[:2]}\n   duck  {sorted(right, key=repr)[:2]}"
    if types[0] != types[1]:
        return f"types differ {sorted(got_names)} {types}"
    return None


def main() -> None:
    import __spark_entry__ as entry
    from tidymill.session import local_session

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    folder = f"{DATA}/sf{args.sf}"
    spark = local_session(8)
    con = connect(folder)
    oracles = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if args.names and not any(n in name for n in args.names):
            continue
        started = time.time()
        try:
            if name in oracles:
                problem = compare(spark, con, fn, oracles[name], folder)
            else:
                problem = None if fn(spark, folder).count() >= 0 else "no rows"
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        bad += problem is not None
        kind = "" if name in oracles else " (rows only)"
        print(f"{'FAIL' if problem else 'ok':4} {time.time() - started:5.1f}s {name}{kind} {problem or ''}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
