"""Run queries on Spark and DuckDB side by side and compare; `python tests/check_oracle.py [names] [--sf 0.01]`."""

from __future__ import annotations

import argparse
import collections
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if value is None:
        return "\0null"
    if isinstance(value, bool):
        return repr(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, int):
        return repr(value)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(_plain(v) for v in value) + "]"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, collections.Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(spark, con, folder, name, run, sql):
    started = time.time()
    frame = run(spark, folder)
    got = frame.toArrow()
    spark_rows = list(zip(*[c.to_pylist() for c in got.columns])) if got.num_columns else []
    seconds = time.time() - started
    if sql is None:
        return ("rows", len(spark_rows), seconds, "")
    rel = con.execute(sql)
    sql_rows = rel.fetchall()
    sql_cols = [d[0] for d in rel.description]
    a_names, a = rows_of(got.column_names, spark_rows)
    b_names, b = rows_of(sql_cols, sql_rows)
    if a_names != b_names:
        return ("COLUMNS", len(spark_rows), seconds, f"{a_names} vs {b_names}")
    if a != b:
        only_a, only_b = a - b, b - a
        return (
            "DIFF",
            len(spark_rows),
            seconds,
            f"spark {sum(a.values())} sql {sum(b.values())} cols {a_names}\n   spark: {list(only_a)[:3]}\n   sql:   {list(only_b)[:3]}",
        )
    types = dict(zip(sql_cols, [str(d[1]) for d in rel.description]))
    odd = [
        f"{f.name}:{f.type}/{types[f.name]}"
        for f in got.schema
        if ("HUGEINT" in types[f.name] or "DECIMAL" in types[f.name] or "decimal" in str(f.type))
    ]
    return ("ok" if not odd else "TYPES", len(spark_rows), seconds, " ".join(odd))


def main():
    parser = argparse.ArgumentParser()
    parser.add_argument("names", nargs="*")
    parser.add_argument("--sf", default="0.01")
    args = parser.parse_args()
    import __spark_entry__ as entry

    from plantmetrics.session import local_session

    spark = local_session("8")
    folder = f"/root/testdata/sf{args.sf}"
    con = connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not args.names or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in args.names)]
    bad = 0
    for name in names:
        try:
            status, rows, seconds, note = compare(spark, con, folder, name, queries[name], oracles.get(name))
        except Exception as error:  # noqa: BLE001
            status, rows, seconds, note = "ERROR", -1, 0, f"{type(error).__name__}: {str(error)[:700]}"
        bad += status not in ("ok", "rows")
        if status not in ("ok",) or seconds > 5 or args.names or rows == 0:
            print(f"{status:8s} {name:28s} rows={rows} {seconds:.1f}s {note}", flush=True)
    print(f"{len(names)} queries, {bad} bad, {sum(n in oracles for n in names)} with SQL")


if __name__ == "__main__":
    main()
