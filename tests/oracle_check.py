"""Runs registered queries and their SQL side by side: python -m tests.oracle_check [sf_dir] [names...]"""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def normalise(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind in "iufb" or str(df[c].dtype) in ("Int64", "boolean"):
            df[c] = df[c].astype("float64")
        else:
            df[c] = df[c].map(lambda v: "<null>" if v is None or v is pd.NA or v != v else str(v).lower())
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def differences(got: pd.DataFrame, want: pd.DataFrame) -> str:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns: only spark {set(got) - set(want)}, only sql {set(want) - set(got)}"
    if len(got) != len(want):
        return f"rows: spark {len(got)}, sql {len(want)}"
    a, b = normalise(got), normalise(want)
    for c in a.columns:
        same = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        if not same.all():
            k = (~same).idxmax()
            return f"column {c}: {(~same).sum()} differ, first spark {a[c][k]!r}, sql {b[c][k]!r}"
    return ""


def check(spark, sf_dir: str, names=None) -> dict[str, str]:
    import __spark_entry__ as entry

    con = connect(sf_dir)
    queries, sql = entry.queries(), entry.oracle_sql()
    out = {}
    for name in names or queries:
        t0 = time.time()
        got = queries[name](spark, sf_dir).toPandas()
        t1 = time.time()
        verdict = "rows only"
        if name in sql:
            verdict = differences(got, con.execute(sql[name]).df()) or "ok"
        out[name] = verdict
        print(f"{name:24s} {len(got):8d} rows {t1 - t0:7.2f}s  {verdict}", flush=True)
    return out


if __name__ == "__main__":
    from duskrank.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    result = check(local_session(), sf, sys.argv[2:] or None)
    bad = {k: v for k, v in result.items() if v not in ("ok", "rows only")}
    print("FAILED" if bad else "ALL OK", bad)
    sys.exit(bool(bad))
