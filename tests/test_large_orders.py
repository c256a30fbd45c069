"""Orders of more suppliers than the twins of the order queries enumerate: the queries give their rows, as the same SQL does once its bound is raised."""

import random

import duckdb
import pytest

from grovespark.plans import queries

SIZES = {1: 3, 2: 16, 3: 17, 4: 18}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path, rng = str(tmp_path_factory.mktemp("orders")), random.Random(1)
    spark.createDataFrame([(s, rng.randrange(25)) for s in range(60)], "s_suppkey long, s_nationkey int").coalesce(1).write.parquet(f"{path}/supplier.parquet")
    lines = [(o, s) for o, n in SIZES.items() for s in rng.sample(range(60), n)]
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long").coalesce(1).write.parquet(f"{path}/lineitem.parquet")
    return path


def asked(folder, sql):
    con = duckdb.connect()
    for name in ("supplier", "lineitem"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    return {r[0]: r[1:] for r in con.execute(sql).fetchall()}


def test_queries_have_the_orders_that_the_bounded_sql_leaves_out(spark, folder):
    short = asked(folder, queries.ORACLES["td_small_batch"])
    want = asked(folder, queries._mask_dp(queries.ORDERS, "ov", "oe", most=18))
    assert set(short) == {"1", "2"} and set(want) == {"1", "2", "3", "4"} and short.items() <= want.items()
    got = {name: {r["graph_id"]: r for r in queries.QUERIES[name](spark, folder).collect()} for name in ("td_small_batch", "td_forms_orders", "td_fixpoint_orders", "fixpoint_forests_orders", "td_window")}
    for name in ("td_small_batch", "td_forms_orders"):
        assert {k: (r["n"], r["td"]) for k, r in got[name].items()} == want
    assert {k: r["td"] for k, r in got["td_fixpoint_orders"].items()} == {k: td for k, (_, td) in want.items()}
    assert {k: (r["depth"], r["uncovered"], r["is_tree"]) for k, r in got["fixpoint_forests_orders"].items()} == {k: (td, 0, True) for k, (_, td) in want.items()}
    assert {k: (r["low"], r["high"]) for k, r in got["td_window"].items()} == {k: (td <= 2, td >= 3) for k, (_, td) in want.items()}
