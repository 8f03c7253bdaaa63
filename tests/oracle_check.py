"""Run registered Spark queries next to their DuckDB oracle SQL and compare.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
Compares column names, row counts and the multiset of rows (exactly, and
with a 1e-9 relative float tolerance).
"""

from __future__ import annotations

import math
import os
import sys
import time
from decimal import Decimal

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from kpiloom.sources.tables import TABLES  # noqa: E402


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v, approx):
    if v is None:
        return None
    if isinstance(v, Decimal):
        v = float(v)
    if hasattr(v, "item") and not isinstance(v, (list, tuple, dict)):
        try:
            v = v.item()
        except Exception:
            pass
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        if math.isinf(v):
            return v
        if approx:
            return float(f"{v:.9g}")
        return v
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, approx) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x, approx)) for k, x in v.items()))
    return str(v) if not isinstance(v, (int, str)) else v


def rows_of(cols, records, approx):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i], approx) for i in order) for r in records]
    return sorted(out, key=repr)


def compare(spark, con, name, fn, sql, sf_dir, verbose=True):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    if sql is None:
        return {"name": name, "rows": len(s_rows), "oracle": False, "sec": round(t1 - t0, 2)}
    rel = con.sql(sql)
    d_cols = rel.columns
    d_rows = rel.fetchall()
    res = {"name": name, "rows": len(s_rows), "oracle_rows": len(d_rows), "sec": round(t1 - t0, 2),
           "cols_match": sorted(s_cols) == sorted(d_cols)}
    if not res["cols_match"]:
        res["cols"] = (sorted(s_cols), sorted(d_cols))
        return res
    res["exact"] = rows_of(s_cols, s_rows, False) == rows_of(d_cols, d_rows, False)
    a, b = rows_of(s_cols, s_rows, True), rows_of(d_cols, d_rows, True)
    res["approx"] = a == b
    if not res["approx"] and verbose:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        res["diff"] = diff
        res["sorted_cols"] = sorted(s_cols)
    return res


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    from kpiloom.session import get_spark
    from kpiloom.plans.registry import ORACLE, QUERIES, load_all
    load_all()
    spark = get_spark("local[8]", 8)
    con = duck(sf_dir)
    bad = 0
    for name, fn in QUERIES.items():
        if names and name not in names:
            continue
        try:
            r = compare(spark, con, name, fn, ORACLE.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001
            r = {"name": name, "error": f"{type(e).__name__}: {str(e)[:400]}"}
        ok = r.get("exact") or r.get("approx") or (r.get("oracle") is False and "error" not in r)
        bad += 0 if ok else 1
        print(("OK  " if ok else "BAD ") + repr(r), flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
