"""Comparison of a registered query with its SQL in DuckDB, as sorted multisets of rounded rows."""

import os

import numpy as np
import pandas as pd


def _plain(v):
    if isinstance(v, np.ndarray):
        v = v.tolist()
    if isinstance(v, list):
        return str([_plain(x) for x in v])
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (float, np.floating)):
        return repr(round(float(v), 6) + 0.0)
    return str(int(v)) if isinstance(v, (int, np.integer)) else str(v)


def rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted(zip(*[[_plain(v) for v in pdf[c]] for c in cols]))


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(sf_dir):
        path = os.path.join(sf_dir, f)
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con
