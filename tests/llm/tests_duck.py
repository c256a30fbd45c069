"""DuckDB views of the tables, and rows that compare across engines."""

import os
from collections import Counter

import duckdb
import pandas as pd


def duck(folder):
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{f}'")
    return con


def rows(df):
    def plain(x):
        if pd.isna(x):
            return None
        return round(float(x), 6) if isinstance(x, (int, float, bool)) or hasattr(x, "dtype") and x.dtype.kind in "iufb" else str(x)

    return Counter(tuple(map(plain, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None))
