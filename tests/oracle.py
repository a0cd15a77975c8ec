"""Compare registered queries with their SQL on the same parquet tables.

Run as a script: python tests/oracle.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import datetime as dt
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def database(root: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{root}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return ("f", "nan" if value != value else repr(value + 0.0))
    if isinstance(value, dt.datetime):
        return ("t", value.isoformat())
    return (type(value).__name__, repr(value))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def differences(con, df, sql: str) -> list[str]:
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    want_cols, want = rows_of([c[0] for c in cursor.description], cursor.fetchall())
    problems = []
    if got_cols != want_cols:
        problems.append(f"columns {got_cols} != {want_cols}")
    if len(got) != len(want):
        problems.append(f"rows {len(got)} != {len(want)}")
    if not problems:
        bad = [(g, w) for g, w in zip(got, want) if g != w]
        if bad:
            problems.append(f"{len(bad)} of {len(got)} rows differ, first: {bad[0]}")
    return problems


def main(argv: list[str]) -> int:
    import __spark_entry__ as contract
    from cycle_analytics.session import build_session, clear_work

    root = "/root/testdata/sf0.01"
    if "--sf" in argv:
        at = argv.index("--sf")
        root = argv[at + 1]
        del argv[at : at + 2]
    spark = build_session(
        "oracle", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, failed = database(root), contract.oracle_sql(), 0
    for name, fn in contract.queries().items():
        if argv and name not in argv:
            continue
        began = time.time()
        try:
            df = fn(spark, root)
            if name in oracles:
                problems = differences(con, df, oracles[name])
            else:
                problems = [] if df.count() else ["no rows"]
        except Exception as error:  # noqa: BLE001
            problems = [f"{type(error).__name__}: {str(error)[:1500]}"]
        clear_work(spark)
        failed += bool(problems)
        mark = "ok" if not problems else "DIFF"
        note = "" if name in oracles else " (rows only)"
        print(f"{mark:5}{name}{note} {time.time() - began:.1f}s {' | '.join(problems)}", flush=True)
    print("failed:", failed)
    spark.stop()
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
