"""Run registered queries in Spark and their checking SQL in DuckDB and compare whole results.

    python tests/oracle_check.py [--sf DIR] [name prefix ...]
"""

from __future__ import annotations

import argparse
import datetime
import decimal
import math
import pathlib
import sys
import time

import duckdb

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def family(value: object) -> str:
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int):
        return "int"
    if isinstance(value, (float, decimal.Decimal)):
        return "float" if isinstance(value, float) else "decimal"
    if isinstance(value, datetime.datetime):
        return "timestamp"
    return type(value).__name__


def plain(value: object) -> object:
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    if isinstance(value, float):
        return value + 0.0
    if hasattr(value, "asDict"):
        return tuple(plain(v) for v in value)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def sort_key(row: tuple) -> tuple:
    return tuple((v is not None, str(v)) for v in row)


def compare(spark_df, con, sql: str) -> str:
    left_names = sorted(spark_df.columns)
    got = [tuple(plain(r[c]) for c in left_names) for r in spark_df.collect()]
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    rows = cursor.fetchall()
    if sorted(names) != left_names:
        return f"columns differ: {left_names} vs {sorted(names)}"
    order = [names.index(c) for c in left_names]
    want = [tuple(plain(r[i]) for i in order) for r in rows]
    if len(got) != len(want):
        return f"rows differ: {len(got)} vs {len(want)}"
    got.sort(key=sort_key)
    want.sort(key=sort_key)
    for i, name in enumerate(left_names):
        kinds = {family(r[i]) for r in got if r[i] is not None}, {family(r[i]) for r in want if r[i] is not None}
        if kinds[0] != kinds[1]:
            return f"type of {name}: {kinds[0]} vs {kinds[1]}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, first: {bad[0][0]} vs {bad[0][1]}"
    return f"ok {len(got)} rows"


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    import __spark_entry__ as entry
    from basketry.session import local_session

    spark = local_session("8")
    con = duck(args.sf)
    oracles = entry.oracle_sql()
    failed = 0
    for name, query in entry.queries().items():
        if args.names and not any(name.startswith(p) for p in args.names):
            continue
        start = time.time()
        try:
            df = query(spark, args.sf)
            if name in oracles:
                verdict = compare(df, con, oracles[name])
            else:
                verdict = f"ok {len(df.collect())} rows (no SQL)"
        except Exception as err:  # noqa: BLE001
            verdict = f"ERROR {type(err).__name__}: {str(err)[:400]}"
        if not verdict.startswith("ok"):
            failed += 1
        print(f"{name:<45} {time.time() - start:6.2f}s {verdict}", flush=True)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
