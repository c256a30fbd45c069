"""Graphs that fit a row are shuffled once, and come out as the larger ones do."""

import random

import pytest

from grovespark.functions.loops import written
from grovespark.operators import graph, treedepth
from grovespark.plans import tables


def shuffles(monkeypatch, make):
    """Exchanges by key in the plans of a result and of the tables written on the way."""
    plans = []
    plan = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df
    for module in (graph, tables):
        monkeypatch.setattr(module, "written", lambda df: written(plan(df)))
    plan(make())
    return sum(p.count("Exchange hashpartitioning") + p.count("Exchange rangepartitioning") for p in plans)


@pytest.fixture(scope="module")
def batch(spark):
    rng, v, e = random.Random(5), [], []
    for k in range(30):
        n, p = rng.randint(1, 24), rng.random() * 0.4
        v += [(f"g{k}", x * 3) for x in range(n)]
        e += [(f"g{k}", a * 3, b * 3) for b in range(n) for a in range(b) if rng.random() < p]
    return written(spark.createDataFrame(v, "graph_id string, v int")), written(spark.createDataFrame(e, "graph_id string, u int, v int"))


def same(a, b):
    a, b = sorted(map(tuple, a.collect())), sorted(map(tuple, b.collect()))
    assert a == b and len(a) > 20


def test_windows_shuffle_lines_once(spark, monkeypatch):
    assert shuffles(monkeypatch, lambda: graph.canonical_edges(tables.window_graphs(spark, "/root/testdata/sf0.001")[1])) <= 2


def test_core_numbers(batch, monkeypatch):
    same(graph.core_numbers(*batch), graph.core_numbers(*batch, 1))
    assert shuffles(monkeypatch, lambda: graph.core_numbers(*batch)) <= 2


def test_two_and_three_core(batch, monkeypatch):
    whole = [graph.k_core(*batch, k) for k in (2, 3)]
    small = shuffles(monkeypatch, lambda: graph.k_core(*batch, 2)[0])
    monkeypatch.setattr(graph, "CORE_BLOCK", 1)
    for k, kept in zip((2, 3), whole):
        for a, b in zip(kept, graph.k_core(*batch, k)):
            same(a, b)
    assert small <= 2


def test_core_components(batch, monkeypatch):
    assert shuffles(monkeypatch, lambda: graph.core_components(*batch, 3)) <= 8


def test_core_lower(batch, monkeypatch):
    assert shuffles(monkeypatch, lambda: treedepth.core_lower(*batch)) <= 3


def test_non_dominated(batch, monkeypatch):
    same(graph.non_dominated(*batch), graph.non_dominated(*batch, whole=0))
    assert shuffles(monkeypatch, lambda: graph.non_dominated(*batch)) <= 2


def test_articulation_rounds(batch, monkeypatch):
    same(graph.articulation_rounds(*batch), graph.articulation_rounds(*batch, whole=0))
    assert shuffles(monkeypatch, lambda: graph.articulation_rounds(*batch)) <= 2


def test_twins(batch, monkeypatch):
    same(graph.twins(*batch), graph.twins(*batch, whole=0))
    assert shuffles(monkeypatch, lambda: graph.twins(*batch)) <= 2


def test_rooted_bounds_of_equal_components(spark, monkeypatch):
    """A thousand paths of four in places of their own are one form."""
    from grovespark.functions import bitgraph as bg
    from grovespark.operators import kernels

    v = spark.createDataFrame([("g", 10 * k + x) for k in range(1000) for x in range(4)], "graph_id string, v int")
    e = spark.createDataFrame([("g", 10 * k + x, 10 * k + x + 1) for k in range(1000) for x in range(3)], "graph_id string, u int, v int")
    made, run = [], {}
    monkeypatch.setattr(graph, "_whole", lambda v, e, kernel, *x: run.update(kernel=kernel))
    monkeypatch.setattr(bg, "Solver", lambda *x, solver=bg.Solver: made.append(1) or solver(*x))
    kernels.rooted_bounds(v, e)
    import pyarrow as pa

    numbers = [a << 32 | b for k in range(1000) for a, b in [(10 * k + x, 10 * k + x) for x in range(4)] + [(10 * k + x, 10 * k + x + 1) for x in range(3)]]
    (out,) = run["kernel"](iter([pa.RecordBatch.from_pydict({"graph_id": ["g"], "all": [numbers]})]))
    assert out.column("lower").to_pylist() == out.column("upper").to_pylist() == [3, 3, 3, 3] * 1000
    assert out.num_rows == 4000 and len(made) == 1


def plans_of(spark, monkeypatch, name):
    """The plans of a query over sf0.001 and of all that it writes on the way."""
    from grovespark.plans import queries

    plans = []
    plan = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df
    for module in (graph, tables):
        monkeypatch.setattr(module, "written", lambda df: written(plan(df)))
    plan(queries.QUERIES[name](spark, "/root/testdata/sf0.001"))
    return plans


@pytest.mark.parametrize("name", ["two_core", "three_core", "three_core_components", "td_core_lower_windows"])
def test_core_queries_shuffle_lines_once(spark, monkeypatch, name):
    """The lines are read by one shuffle, and neither windows' edges nor cores by any."""
    plans = plans_of(spark, monkeypatch, name)
    assert sum(p.count("/lineitem.parquet") for p in plans) == 1
    assert plans[-1].count("hashpartitioning(graph_id") <= (2 if name == "three_core_components" else 1)


def test_rows_equal_graphs(spark):
    """Packed rows hold the vertices and edges of all_graphs, each once."""
    (rows,), (v, e) = (f(spark, "/root/testdata/sf0.001") for f in (tables.all_rows, tables.all_graphs))
    ends = [(g, x >> 32, x & 0xFFFFFFFF) for g, all_ in rows.collect() for x in all_]
    assert sorted(ends) == sorted([(g, x, x) for g, x in v.collect()] + [tuple(x) for x in e.collect()])


def test_cores_of_rows(spark, batch):
    """Rows too large for a task go by rounds, others whole, to the same cores, components and bounds."""
    v, e = batch
    rows = graph.packed(v, e)
    for most in (40, 20_000):
        same(graph.core_numbers_of_rows(rows, most), graph.core_numbers(v, e))
        same(graph.core_components_of_rows(rows, 2, most).select("graph_id", "v", "component"), graph.components(*graph.k_core(v, e, 2)))
        same(graph.top_cores_of_rows(rows, most).selectExpr("graph_id", "core + 1"), treedepth.core_lower(v, e))
    same(graph.core_components(v, e, 2), graph.components(*graph.k_core(v, e, 2)))
