"""Run the named queries next to their SQL twins: ``python -m tests.compare [folder] [name ...]``."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def compare(spark, con, folder, name, query, sql) -> tuple[str, int, float]:
    begun = time.time()
    frame = query(spark, folder)
    columns = sorted(frame.columns)
    mine = sorted((tuple(map(str, r)) for r in frame.select(*columns).collect()))
    took = time.time() - begun
    relation = con.sql(sql)
    if sorted(relation.columns) != columns:
        return f"columns {columns} != {sorted(relation.columns)}", len(mine), took
    order = [relation.columns.index(c) for c in columns]
    theirs = sorted(tuple(str(r[i]) for i in order) for r in relation.fetchall())
    if mine == theirs:
        return "ok", len(mine), took
    bad = next(((a, b) for a, b in zip(mine, theirs) if a != b), None)
    return f"rows {len(mine)} / {len(theirs)}, first difference {bad}", len(mine), took


def main() -> None:
    import __spark_entry__ as entry

    from rivulet.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    wanted = sys.argv[2:]
    spark, con = local_session(8), connect(folder)
    for name, query in entry.queries().items():
        if (wanted and name not in wanted) or name not in entry.oracle_sql():
            continue
        try:
            verdict, rows, took = compare(spark, con, folder, name, query, entry.oracle_sql()[name])
        except Exception as problem:  # report and go on with the next query
            verdict, rows, took = f"ERROR {str(problem)[:600]}", -1, 0.0
        print(f"{name:28s} {rows:8d} {took:7.2f}s  {verdict[:700]}", flush=True)


if __name__ == "__main__":
    main()
