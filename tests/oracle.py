"""Compare registered queries with their SQL on DuckDB."""

from __future__ import annotations

import glob
import os

import duckdb
import numpy as np
import pandas as pd


def duck(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        s = df[c]
        if isinstance(s.dtype, pd.DatetimeTZDtype):
            s = s.dt.tz_localize(None)
        if pd.api.types.is_datetime64_any_dtype(s):
            s = s.astype("datetime64[us]")
        elif pd.api.types.is_bool_dtype(s):
            s = s.astype("object")
        elif pd.api.types.is_numeric_dtype(s):
            s = s.astype("float64")
        elif s.map(lambda v: hasattr(v, "isoformat")).any():
            s = pd.to_datetime(s).astype("datetime64[us]")
        df[c] = s
    return df.sort_values(list(df.columns), ignore_index=True)


def differences(spark_df, con, sql: str) -> list[str]:
    got, want = spark_df.toPandas(), con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return [f"columns {sorted(got.columns)} != {sorted(want.columns)}"]
    if len(got) != len(want):
        return [f"rows {len(got)} != {len(want)}"]
    if got.empty:
        return ["both empty"]
    a, b = _plain(got), _plain(want)
    bad = []
    for c in a.columns:
        x, y = a[c], b[c]
        if x.dtype == "float64" and y.dtype == "float64":
            same = (x == y) | (x.isna() & y.isna())
            close = np.isclose(x, y, rtol=0, atol=2e-7, equal_nan=True)
        else:
            same = (x == y) | (x.isna() & y.isna())
            close = same
        if not same.all():
            i = (~same).to_numpy().argmax()
            bad.append(f"{c}: {int((~same).sum())} differ, {int((~close).sum())} far; first {x[i]!r} != {y[i]!r}")
    return bad
