"""Run registered queries in Spark and DuckDB and compare rows, names and types.

    python -m tests.compare [sf_dir] [name prefix ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pyarrow as pa

DEFAULT_DIR = "/root/testdata/sf0.01"


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def _kind(t: pa.DataType) -> str:
    if pa.types.is_large_string(t) or pa.types.is_string(t):
        return "string"
    return str(t)


def rows_of(table: pa.Table) -> tuple[dict[str, str], list[tuple]]:
    names = sorted(table.column_names)
    table = table.select(names)
    kinds = {n: _kind(table.schema.field(n).type) for n in names}
    rows = sorted(zip(*[table.column(n).to_pylist() for n in names]), key=repr)
    return kinds, rows


def difference(spark_table: pa.Table, sql_table: pa.Table) -> str | None:
    kinds, rows = rows_of(spark_table)
    want_kinds, want = rows_of(sql_table)
    if kinds != want_kinds:
        odd = {n: (kinds.get(n), want_kinds.get(n)) for n in {*kinds, *want_kinds}
               if kinds.get(n) != want_kinds.get(n)}
        return f"schema (spark, sql): {odd}"
    if rows != want:
        extra = [r for r in rows if r not in want][:3]
        lacking = [r for r in want if r not in rows][:3]
        return f"rows {len(rows)} vs {len(want)}\n   spark only {extra}\n   sql only   {lacking}"
    return None


def main() -> int:
    from stepwise.session import local_session
    from workload.registry import QUERIES

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else DEFAULT_DIR
    spark = local_session(8)
    con = connect(sf_dir)
    failed = 0
    for name, (run, sql) in QUERIES.items():
        if args and not name.startswith(tuple(args)):
            continue
        start = time.time()
        try:
            got = run(spark, sf_dir).toArrow()
            took = time.time() - start
            problem = None
            if sql:
                start = time.time()
                problem = difference(got, con.execute(sql).to_arrow_table())
        except Exception as error:
            problem, took = f"{type(error).__name__}: {str(error)[:900]}", time.time() - start
            got = None
        failed += problem is not None
        status = "ok  " if problem is None else "FAIL"
        size = got.num_rows if got is not None else "-"
        print(f"{status} {name} rows={size} spark={took:.2f}s sql={time.time() - start:.2f}s"
              f"{'' if sql else ' (no sql)'}", flush=True)
        if problem:
            print("   " + problem)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
