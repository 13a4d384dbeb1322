"""Run a query and its SQL twin side by side: `python -m tests.oracle <sf_dir> [name ...]`."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb

from fleetgauge.catalog import load


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def rows_of_spark(df):
    names = sorted(df.columns)
    return names, sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def rows_of_sql(con, sql):
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    names = sorted(cols)
    at = [cols.index(n) for n in names]
    return names, sorted((tuple(r[i] for i in at) for r in cur.fetchall()), key=repr)


def compare(spark, con, sf_dir, entry):
    """None when equal, else a short text."""
    names, got = rows_of_spark(entry.build(spark, sf_dir))
    if entry.sql is None:
        return None if names else "no columns"
    want_names, want = rows_of_sql(con, entry.sql)
    if names != want_names:
        return f"columns {names} != {want_names}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    for a, b in zip(got, want):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"{names}\n  spark {a}\n  sql   {b}"
    return None if got else "EMPTY"


def main(sf_dir: str, *wanted: str) -> int:
    from fleetgauge.session import local_session
    spark = local_session(8)
    con = connect(sf_dir)
    bad = 0
    for name, entry in load().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t = time.time()
        try:
            problem = compare(spark, con, sf_dir, entry)
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:700]}"
        bad += problem is not None
        tag = "ok " if problem is None else "BAD"
        print(f"{tag} {name:34s} {time.time() - t:5.1f}s {'' if entry.sql else '(rows only) '}{problem or ''}", flush=True)
    print(f"{bad} problem(s)")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(*sys.argv[1:]) else 0)
