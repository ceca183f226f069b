"""Run registered queries beside their SQL twins: ``python -m workload.compare [--sf DIR] [key prefix ...]``."""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


KINDS = {
    "string": "str", "large_string": "str", "int32": "int", "int64": "long", "double": "double", "bool": "bool", "float": "float",
}


def _kind(arrow_type) -> str:
    return KINDS.get(str(arrow_type), str(arrow_type))


def _cell(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return f"{value + 0.0:.9g}"
    return repr(value)


def _rows(table) -> list[tuple]:
    names = sorted(table.column_names)
    lists = [table.column(n).to_pylist() for n in names]
    return sorted(tuple(_cell(v) for v in row) for row in zip(*lists))


def compare(spark, con, key: str, query, sql: str, sf_dir: str) -> tuple[bool, str]:
    started = time.time()
    got = query(spark, sf_dir).toArrow()
    spark_s = time.time() - started
    started = time.time()
    want = con.execute(sql).to_arrow_table()
    duck_s = time.time() - started
    note = f"rows={got.num_rows} spark={spark_s:.1f}s duckdb={duck_s:.1f}s"
    if sorted(got.column_names) != sorted(want.column_names):
        return False, f"columns {sorted(got.column_names)} != {sorted(want.column_names)} {note}"
    types = [
        f"{n}: {got.schema.field(n).type} != {want.schema.field(n).type}"
        for n in got.column_names
        if _kind(got.schema.field(n).type) != _kind(want.schema.field(n).type)
    ]
    if types:
        return False, f"types {types} {note}"
    a, b = _rows(got), _rows(want)
    if a == b:
        return (len(a) > 0), (note if a else f"EMPTY {note}")
    left, right = sorted(set(a) - set(b))[:2], sorted(set(b) - set(a))[:2]
    return False, f"values differ: rows {len(a)} vs {len(b)} {note}\n   spark only {left}\n   sql only   {right}"


def main(argv=None) -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("keys", nargs="*")
    args = parser.parse_args(argv)
    from catalink.session import build_session

    import workload

    if args.keys and args.keys[0].startswith("@"):
        workload.MODULES[:] = args.keys.pop(0)[1:].split(",")
    spark = build_session("compare", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(args.sf)
    oracles = workload.all_oracles()
    bad = 0
    for key, query in workload.all_queries().items():
        if args.keys and not any(key.startswith(k) for k in args.keys):
            continue
        try:
            if key in oracles:
                ok, note = compare(spark, con, key, query, oracles[key], args.sf)
            else:
                started = time.time()
                n = query(spark, args.sf).count()
                ok, note = n > 0, f"rows only: {n} spark={time.time() - started:.1f}s"
        except Exception as error:  # report and go on with the next key
            ok, note = False, f"{type(error).__name__}: {str(error)[:1500]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {key} {note}", flush=True)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
