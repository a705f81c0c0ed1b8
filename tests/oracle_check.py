"""Run registered queries next to their SQL twins in DuckDB.

``python -m tests.oracle_check [sf_dir] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb

from spantab.plans.queries import ORACLES, QUERIES


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def compare(spark, con, name: str, sf_dir: str) -> str | None:
    """None when the two results are equal, else what differs."""
    start = time.time()
    df = QUERIES[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    compare.spark_seconds = time.time() - start
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    types = {"bigint": int, "double": float, "string": str, "boolean": bool}
    bad = [t for t in df.dtypes if t[1] not in types]
    if bad:
        return f"types {bad}"
    for i, n in enumerate(names):
        kinds = {type(r[i]) for r in want if r[i] is not None}
        if kinds - {types[dict(df.dtypes)[n]]}:
            return f"type of {n}: {kinds}"
    a, b = _rows(df.columns, got), _rows(names, want)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    for x, y in zip(a, b):
        if x != y and repr(x) != repr(y):
            return f"{x} != {y}"
    return None


def main() -> int:
    from tests.conftest import make_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:]
    spark = make_session()
    con = connect(sf_dir)
    failed = 0
    for name in QUERIES:
        if chosen and not any(name.startswith(c) for c in chosen):
            continue
        start = time.time()
        try:
            if name in ORACLES:
                verdict = compare(spark, con, name, sf_dir) or "ok"
            else:
                verdict = f"rows only: {QUERIES[name](spark, sf_dir).count()}"
        except Exception as e:  # noqa: BLE001 - report and go on
            verdict = f"{type(e).__name__}: {str(e)[:600]}"
        failed += not verdict.startswith(("ok", "rows only"))
        spark_seconds = getattr(compare, "spark_seconds", 0.0)
        print(f"{name:32s} {time.time() - start:6.2f}s ({spark_seconds:5.2f}s in Spark) {verdict}", flush=True)
    print("failed", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main())
