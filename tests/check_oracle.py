"""Run registered queries against DuckDB on the given tables: python tests/check_oracle.py [names…]."""
import argparse
import glob
import os
import sys
import time

import duckdb
import numpy as np
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entrypoint  # noqa: E402
from cohortspark.session import build_session  # noqa: E402


def duck(folder):
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def normal(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object or str(df[c].dtype) in ("str", "string"):
            s = df[c].map(lambda v: v.tolist() if isinstance(v, np.ndarray) else v)
            sample = s.dropna()
            if len(sample) and all(isinstance(v, (int, float, np.number)) or type(v).__name__ == "Decimal" for v in sample) and not any(isinstance(v, bool) for v in sample):
                df[c] = pd.to_numeric(s, errors="coerce").astype(float)
            else:
                df[c] = s.map(lambda v: None if v is None or (isinstance(v, float) and np.isnan(v)) else str(v))
        elif df[c].dtype == bool or str(df[c].dtype) == "boolean":
            df[c] = df[c].astype(str)
        else:
            df[c] = pd.to_numeric(df[c], errors="coerce").astype(float)
    return df.sort_values(list(df.columns), na_position="first", key=lambda s: s.map(lambda v: "" if v is None else v) if s.dtype == object else s).reset_index(drop=True)


def kinds(df):
    out = {}
    for c in df.columns:
        k = df[c].dtype.kind
        if k == "O" or str(df[c].dtype) in ("str", "string"):
            k = "S"
            v = df[c].dropna()
            if len(v) and isinstance(v.iloc[0], bool):
                k = "b"
            elif len(v) and type(v.iloc[0]).__name__ in ("Decimal", "int", "float"):
                k = type(v.iloc[0]).__name__
        out[c] = "b" if k == "b" or str(df[c].dtype) == "boolean" else ("f" if df[c].isna().any() and k in "if" else k)
    return out


def compare(spark_df, sql_df):
    ka, kb = kinds(spark_df), kinds(sql_df)
    drift = {c: (ka[c], kb[c]) for c in ka if c in kb and ka[c] != kb[c] and not spark_df[c].isna().all()}
    result = values(spark_df, sql_df)
    return result or (f"types {drift}" if drift else "")


def values(spark_df, sql_df):
    a, b = normal(spark_df), normal(sql_df)
    if list(a.columns) != list(b.columns):
        return f"columns {set(a.columns) ^ set(b.columns)}"
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    bad = []
    for c in a.columns:
        x, y = a[c], b[c]
        if x.dtype == float and y.dtype == float:
            same = (x == y) | (x.isna() & y.isna())
        else:
            same = (x.astype(str) == y.astype(str))
        if not same.all():
            i = int(np.flatnonzero(~same.to_numpy())[0])
            bad.append(f"{c}[{i}]: {x[i]!r} != {y[i]!r} ({int((~same).sum())} of {len(a)})")
    return "; ".join(bad)


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("names", nargs="*")
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("--only-sql", action="store_true")
    args = ap.parse_args()
    folder = f"/root/testdata/sf{args.sf}"
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    queries, oracle = entrypoint.queries(), entrypoint.oracle_sql()
    names = [n for n in queries if not args.names or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in args.names)]
    if args.only_sql:
        names = [n for n in names if n in oracle]
    failed = 0
    for n in names:
        t = time.time()
        try:
            got = queries[n](spark, folder).toPandas()
            took = time.time() - t
            note = "rows only" if n not in oracle else compare(got, con.execute(oracle[n]).df())
            ok = n not in oracle or not note
            if len(got) == 0:
                note = f"{note} EMPTY"
        except Exception as e:  # noqa: BLE001
            ok, note, took, got = False, f"{type(e).__name__}: {str(e)[:600]}", time.time() - t, []
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {n:45s} rows={len(got):6d} {took:6.1f}s {note}", flush=True)
    print("failed", failed, "of", len(names))


if __name__ == "__main__":
    main()
