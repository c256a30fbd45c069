"""Forests of graphs in rows: each form is solved once, and what is checked in a row is what the joins find."""

import random

import pytest
from pyspark.sql import functions as F

from grovespark.operators import fixpoint, verify
from grovespark.plans import queries

ROW = "graph_id string, vs array<int>, es array<long>"


def row(name, rng, n, p, first=0):
    return name, list(range(first, first + 3 * n, 3)), [(i << 32) + j for i in range(n) for j in range(i + 1, n) if rng.random() < p]


def tables_of(rows):
    end = lambda x, name: F.expr(f"vs[cast({x} AS int)]").alias(name)
    edges = rows.select("graph_id", "vs", F.explode("es").alias("e")).select("graph_id", end("shiftright(e, 32)", "u"), end("e & 4294967295", "v"))
    return rows.select("graph_id", F.explode("vs").alias("v")), edges


def test_orders_of_one_shape_are_solved_once(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(s, s % 12) for s in range(36)], "s_suppkey long, s_nationkey int").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    lines = [(o, s + 12 * (o % 3)) for o in range(300) for s in range(3 + o % 4 * 3)] + [(7, 1000), (None, 3)]
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    met, solve = [], fixpoint.solve
    monkeypatch.setattr(fixpoint, "solve", lambda v, e: met.append(v.select("graph_id").distinct().count()) or solve(v, e))
    got = {r["graph_id"]: (r["depth"], r["uncovered"], r["is_tree"]) for r in queries.QUERIES["fixpoint_forests_orders"](spark, str(tmp_path)).collect()}
    assert len(got) == 300 and {r[1:] for r in got.values()} == {(0, True)} and len({(int(k) % 4, r[0]) for k, r in got.items()}) == 4
    assert met == [4]


def test_forests_of_rows_are_those_of_tables(spark):
    rng = random.Random(3)
    rows = spark.createDataFrame([row(f"g{k}", rng, 1 + k % 11, rng.random(), k) for k in range(80)], ROW)
    vertices, edges = (x.cache() for x in queries.positive(*tables_of(rows)))
    want = {tuple(r) for r in queries._digest(edges, fixpoint.solve(vertices, edges).forest()).collect()}
    assert {tuple(r) for r in verify.digest_of_rows(fixpoint.forests_of_rows(rows)).collect()} == want and len(want) == 80
    assert verify.digest_of_rows(fixpoint.forests_of_rows(rows.where("false"))).count() == 0


@pytest.mark.parametrize("seed", [0, 1])
def test_bad_forests_are_found_in_rows_as_by_joins(spark, seed):
    rng, data = random.Random(seed), []
    for k in range(60):
        n = 1 + k % 9
        up = [rng.randrange(n + 1) for _ in range(n)] if k % 2 else [rng.randrange(i + 1) for i in range(n)]  # odd ones may have cycles
        data.append((*row(f"g{k}", rng, n, 0.4, k), up))
    data.append(("deep", list(range(500)), [(i << 32) + 499 for i in range(0, 499, 7)], list(range(500))))
    rows = spark.createDataFrame(data, f"{ROW}, up array<int>").repartition(3)
    tree = rows.select("graph_id", "vs", F.posexplode("up").alias("i", "p")).select("graph_id", F.expr("vs[i] + 1").alias("v"), F.expr("if(p = 0, 0, vs[p - 1] + 1)").alias("parent"))
    want = {tuple(r) for r in queries._digest(queries.positive(*tables_of(rows))[1], tree).collect()}
    got = {tuple(r) for r in verify.digest_of_rows(rows).collect()}
    assert got == want and any(not r[3] for r in got) and any(r[2] for r in got) and ("deep", 500, 0, True) in got
