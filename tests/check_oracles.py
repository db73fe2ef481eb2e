"""Side-by-side run of registered queries against DuckDB: ``python tests/check_oracles.py [sf_dir] [name ...]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted((tuple(r[i] for i in order) for r in rows), key=lambda r: [(x is None, str(x)) for x in r])


def compare(spark, con, name: str, sf_dir: str) -> tuple[str, float, int]:
    start = time.time()
    df = entry.queries()[name](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    seconds = time.time() - start
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return ("rows-only", seconds, len(rows))
    cursor = con.execute(sql)
    want = cursor.fetchall()
    names, got_rows = canonical(df.columns, rows)
    want_names, want_rows = canonical([d[0] for d in cursor.description], want)
    if names != want_names:
        return (f"COLUMNS {names} vs {want_names}", seconds, len(rows))
    if len(got_rows) != len(want_rows):
        return (f"ROWS {len(got_rows)} vs {len(want_rows)}", seconds, len(rows))
    bad = [(g, w) for g, w in zip(got_rows, want_rows) if g != w]
    if bad:
        return (f"VALUES {len(bad)} differ, first {bad[0]}", seconds, len(rows))
    return ("ok", seconds, len(rows))


if __name__ == "__main__":
    from tests.conftest import make_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    spark, con = make_session(), connect(sf)
    wanted = sys.argv[2:] or list(entry.queries())
    for n in wanted:
        try:
            verdict, seconds, count = compare(spark, con, n, sf)
        except Exception as error:
            verdict, seconds, count = f"ERROR {type(error).__name__}: {str(error)[:600]}", 0.0, 0
        print(f"{n:32s} {seconds:6.2f}s {count:7d}  {verdict}", flush=True)
