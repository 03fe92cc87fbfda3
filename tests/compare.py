"""Run catalogue queries next to their SQL twins and compare the rows."""

from __future__ import annotations

import math
import sys
import time

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def norm(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(norm(r[i]) for i in order) for r in rows), key=lambda t: tuple((v is None, str(v)) for v in t)
    )


def compare(spark, con, name, fn, sql, sf_dir):
    started = time.time()
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    spent = time.time() - started
    cur = con.execute(sql)
    want = rows_of([c[0] for c in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return False, f"columns {got[0]} != {want[0]}", spent
    if got[1] != want[1]:
        gs, ws = set(got[1]), set(want[1])
        return False, f"{len(got[1])} vs {len(want[1])} rows; only ours {list(gs - ws)[:2]}; only sql {list(ws - gs)[:2]}", spent
    return True, f"{len(got[1])} rows", spent


if __name__ == "__main__":
    import os
    import tempfile

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from provenir.session import build_session

    sf = os.environ.get("SF", "/root/testdata/sf0.01")
    names = sys.argv[1:] or list(entry.queries())
    spark = build_session(
        "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "16g",
                       "spark.checkpoint.dir": tempfile.mkdtemp(prefix="run-", dir="/tmp")})
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf), 0
    for name in names:
        fn, sql = entry.queries()[name], entry.oracle_sql().get(name)
        try:
            if sql is None:
                t = time.time()
                n = len(fn(spark, sf).collect())
                print(f"--   {name}: {n} rows, no SQL ({time.time() - t:.1f}s)", flush=True)
                continue
            ok, note, spent = compare(spark, con, name, fn, sql, sf)
        except Exception as exc:  # noqa: BLE001
            ok, note, spent = False, f"{type(exc).__name__}: {str(exc)[:600]}", 0.0
        bad += not ok
        print(f"{'ok' if ok else 'BAD'}   {name}: {note} ({spent:.1f}s)", flush=True)
    print("failures:", bad)
    spark.stop()
