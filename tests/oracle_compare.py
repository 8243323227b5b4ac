"""Run registered queries in Spark and their oracle SQL in DuckDB; compare results.

Usage: python tests/oracle_compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v          # exact: both engines must agree bit for bit
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if isinstance(v, bool):
        return int(v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


# Spark simple type names → DuckDB type names, for the schema part of the comparison.
SPARK_TO_DUCKDB = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE",
                   "boolean": "BOOLEAN", "float": "FLOAT", "smallint": "SMALLINT", "date": "DATE"}


def duckdb_conn(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, sf_dir, names=None, verbose=True):
    import __spark_entry__ as entry
    qs, sql = entry.queries(), entry.oracle_sql()
    con = duckdb_conn(sf_dir)
    results = {}
    for name in names or list(qs):
        t0 = time.time()
        df = qs[name](spark, sf_dir)
        s_cols, s_rows = rows_of(df.columns, [tuple(r) for r in df.collect()])
        t1 = time.time()
        if name not in sql:
            results[name] = ("rows-only", len(s_rows))
            if verbose:
                print(f"{name:24s} rows-only n={len(s_rows)} spark={t1 - t0:.1f}s")
            continue
        rel = con.sql(sql[name])
        d_types = dict(zip(rel.columns, [str(t) for t in rel.types]))
        d_cols, d_rows = rows_of(list(rel.columns), rel.fetchall())
        type_diff = {c: (t, d_types.get(c)) for c, t in df.dtypes
                     if SPARK_TO_DUCKDB.get(t, t) != d_types.get(c)}
        ok = (s_cols == d_cols) and (s_rows == d_rows) and not type_diff
        results[name] = ok
        if verbose:
            print(f"{name:24s} {'OK  ' if ok else 'FAIL'} n={len(s_rows)}/{len(d_rows)} spark={t1 - t0:.1f}s")
            if not ok:
                if type_diff:
                    print("   types spark/duckdb:", type_diff)
                if s_cols != d_cols:
                    print("   cols spark :", s_cols)
                    print("   cols duckdb:", d_cols)
                else:
                    ss, dd = set(s_rows), set(d_rows)
                    print("   only spark :", sorted(ss - dd, key=repr)[:3])
                    print("   only duckdb:", sorted(dd - ss, key=repr)[:3])
    return results


if __name__ == "__main__":
    from tidewater.session import build_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session()
    res = compare(spark, sf, sys.argv[2:] or None)
    bad = [k for k, v in res.items() if v is False]
    print("FAILED:", bad if bad else "none")
