"""Spark-vs-DuckDB comparison used by the tests and by hand.

Mirrors the driver's gate: same row count, same column names, and the same
order-insensitive multiset of rows (values normalised: floats rounded to 6
places, NaN/None unified).

    python tests/oracle_compare.py [sf_dir] [key ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None or v is pd.NA:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        r = round(v, 6)
        return 0.0 if r == 0 else r
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def rows_of(pdf):
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        out.append(tuple(_norm(x) for x in rec))
    return cols, sorted(out, key=repr)


def compare(spark, con, key, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir).toPandas()
    t1 = time.time()
    ddf = con.execute(sql).df()
    sc, sr = rows_of(sdf)
    dc, dr = rows_of(ddf)
    problems = []
    if sc != dc:
        problems.append(f"columns spark={sc} duck={dc}")
    if len(sr) != len(dr):
        problems.append(f"rows spark={len(sr)} duck={len(dr)}")
    elif sr != dr:
        bad = [(a, b) for a, b in zip(sr, dr) if a != b][:3]
        problems.append(f"values differ, e.g. {bad}")
    return problems, len(sr), t1 - t0


def main(argv):
    from __spark_entry__ import oracle_sql, queries
    from txrisk.session import get_session

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    keys = argv[2:]
    spark = get_session()
    con = duck(sf_dir)
    qs, sqls = queries(), oracle_sql()
    n_ok = n_bad = 0
    for k in (keys or list(qs)):
        if k not in sqls:
            try:
                print(f"ROWS  {k}: {qs[k](spark, sf_dir).count()} rows (no oracle)")
            except Exception as e:  # report and continue
                n_bad += 1
                print(f"FAIL  {k}: error {type(e).__name__}: {str(e)[:300]}")
            continue
        try:
            problems, n, dt = compare(spark, con, k, qs[k], sqls[k], sf_dir)
        except Exception as e:  # report and continue
            problems, n, dt = [f"error {type(e).__name__}: {str(e)[:300]}"], -1, 0
        if problems:
            n_bad += 1
            print(f"FAIL  {k}: " + " | ".join(problems))
        else:
            n_ok += 1
            print(f"OK    {k}: {n} rows {dt:.2f}s")
    print(f"{n_ok} ok, {n_bad} failed")
    return n_bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
