"""Every registered graph query against its DuckDB twin on the smallest tables."""

import os
from collections import Counter

import duckdb
import pandas as pd
import pytest

from grovespark import catalog

SF = "/root/testdata/sf0.001"


def rows(df):
    plain = lambda x: None if not isinstance(x, (list, tuple)) and pd.isna(x) else round(float(x), 6) if isinstance(x, (int, float, bool)) or hasattr(x, "dtype") and x.dtype.kind in "iufb" else str(x)
    return Counter(tuple(map(plain, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None))


def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_oracle(spark, name):
    got, want = catalog.queries()[name](spark, SF).toPandas(), duck().execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_solver_on_trade_graph_is_verified(spark):
    assert catalog.queries()["verify_solved"](spark, SF).where("NOT ok").isEmpty()


def test_solver_on_windows_is_exact_and_verified(spark):
    from grovespark.functions.loops import written
    from grovespark.operators import kernels, verify
    from grovespark.plans import queries, tables

    vertices, edges = queries.positive(*tables.window_graphs(spark, SF))
    solved = written(kernels.solve(vertices, edges, 60))
    assert solved.where("status != 'exact'").isEmpty() and solved.count() == vertices.select("graph_id").distinct().count() > 100
    declared = solved.selectExpr("graph_id", "td AS depth")
    assert verify.verify(vertices, edges, kernels.trees(solved), declared).where("NOT ok").isEmpty()
