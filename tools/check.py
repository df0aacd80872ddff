"""Run registered queries next to their DuckDB SQL and compare names, rows and values.

python tools/check.py [--sf 0.01] [key-prefix ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from cohortloom.plans import catalog  # noqa: E402
from cohortloom.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value


def order(row):
    return tuple((v is not None, type(v).__name__ not in ("int", "float"), str(type(v).__name__ == "bool"), v if isinstance(v, (int, float)) else str(v)) if v is not None else (False, False, "", 0) for v in row)


def sorted_rows(columns, rows):
    positions = sorted(range(len(columns)), key=lambda i: columns[i])
    table = [tuple(plain(row[i]) for i in positions) for row in rows]
    return [columns[i] for i in positions], sorted(table, key=order)


def close(a, b):
    if isinstance(a, float) and isinstance(b, (int, float)):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("keys", nargs="*")
    args = parser.parse_args()
    folder = f"/root/testdata/sf{args.sf}"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    duck = duckdb.connect()
    for name in TABLES:
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    bad = 0
    for key, run in catalog.QUERIES.items():
        if args.keys and not any(key == k or key.startswith(k) for k in args.keys):
            continue
        started = time.time()
        try:
            frame = run(spark, folder)
            got_names, got = sorted_rows(frame.columns, [tuple(r) for r in frame.collect()])
        except Exception as error:  # keep going: the report lists every failure
            bad += 1
            print(f"FAIL  {key}: spark: {str(error)[:1500]}", flush=True)
            continue
        took = time.time() - started
        if key not in catalog.ORACLE:
            print(f"rows  {key}: {len(got)} rows {took:.1f}s {got_names} {got[:1]}"[:230], flush=True)
            continue
        try:
            cursor = duck.execute(catalog.ORACLE[key])
            want_names, want = sorted_rows([d[0] for d in cursor.description], cursor.fetchall())
        except Exception as error:
            bad += 1
            print(f"FAIL  {key}: duckdb: {str(error)[:1500]}", flush=True)
            continue
        types = dict((d[0], str(d[1])) for d in cursor.description)
        if got_names != want_names or len(got) != len(want):
            bad += 1
            print(f"FAIL  {key}: names {got_names} / {want_names}, rows {len(got)} / {len(want)}", flush=True)
        elif got != want:
            near = all(all(close(x, y) for x, y in zip(a, b)) for a, b in zip(got, want))
            pairs = [(a, b) for a, b in zip(got, want) if a != b][:3]
            bad += 1
            print(f"{'NEAR' if near else 'FAIL'}  {key}: {len(got)} rows; {got_names} {pairs}", flush=True)
        else:
            kinds = {f.name: f.dataType.simpleString() for f in frame.schema.fields}
            print(f"ok    {key}: {len(got)} rows {took:.1f}s" + ("" if len(got) else "  EMPTY"), flush=True)
            odd = [(n, kinds[n], types[n]) for n in got_names if (kinds[n], types[n]) not in SAME]
            if odd:
                print(f"      types differ: {odd}", flush=True)
    print(f"{bad} not equal")
    return 1 if bad else 0


SAME = {
    ("string", "VARCHAR"), ("string", "STRING"), ("bigint", "BIGINT"), ("int", "INTEGER"), ("double", "DOUBLE"), ("boolean", "BOOLEAN"),
    ("array<string>", "VARCHAR[]"), ("timestamp_ntz", "TIMESTAMP"), ("array<bigint>", "BIGINT[]"), ("array<double>", "DOUBLE[]"),
}

if __name__ == "__main__":
    sys.exit(main())
