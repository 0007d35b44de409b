"""Compare registered queries with their SQL: ``python tests/oracle_check.py 0.01 name...``."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, bool):
        return int(v)
    if hasattr(v, "as_tuple"):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return 0.0 if v == 0 else v
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir, fn, sql) -> str | None:
    """None when equal, else what differs."""
    df = fn(spark, sf_dir)
    got = df.collect()
    if sql is None:
        return None if df.columns else "no columns"
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    want = res.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    a, b = _rows(df.columns, got), _rows(names, want)
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}; first {a[:1]} vs {b[:1]}"
    for x, y in zip(a, b):
        if x != y:
            bad = [(n, u, w) for n, u, w in zip(sorted(names), x, y) if u != w]
            return f"differs: {bad[:4]} in {x} vs {y}"
    kinds = {n: type(v) for n, v in zip(sorted(names), (b[0] if b else ()))}
    for n, v in zip(sorted(names), a[0] if a else ()):
        if v is not None and kinds[n] is not type(None) and type(v) is not kinds[n]:
            return f"type of {n}: {type(v)} vs {kinds[n]}"
    return None


def main() -> int:
    from riskloom.session import local_session
    import __spark_entry__ as entry

    sf_dir = f"/root/testdata/sf{sys.argv[1]}"
    wanted = sys.argv[2:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, fn in queries.items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            problem = compare(spark, con, sf_dir, fn, oracles.get(name))
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        took = time.time() - start
        mark = "ok" if problem is None else "FAIL"
        if name not in oracles:
            mark += " (rows only)"
        if problem or took > 6 or os.environ.get("VERBOSE"):
            print(f"{mark:5} {took:6.1f}s {name} {problem or ''}", flush=True)
        failed += problem is not None
    print(f"{len(queries)} queries, {len(oracles)} with SQL, {failed} failed")
    return failed


if __name__ == "__main__":
    raise SystemExit(main())
