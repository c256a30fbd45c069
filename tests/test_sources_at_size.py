"""What the driver does for the data sources' queries stays small: planning loads no pyarrow, windows are numbered in their rows, commits list few files at a time."""

import subprocess
import sys

import pytest

from grovespark.plans import queries, tables
from grovespark.sources import datasource


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("windows"))
    put = lambda rows, schema, name: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{name}.parquet")
    put([(n, n % 5) for n in range(25)], "n_nationkey int, n_regionkey int", "nation")
    put([(s, s % 25) for s in range(40)], "s_suppkey long, s_nationkey int", "supplier")
    put([(c, c * 7 % 25) for c in range(30)], "c_custkey long, c_nationkey int", "customer")
    put([(o, o % 30) for o in range(200)], "o_orderkey long, o_custkey long", "orders")
    put([(o, (o * k * 13 + k) % 40) for o in range(200) for k in range(o % 6)], "l_orderkey long, l_suppkey long", "lineitem")
    return path


@pytest.fixture
def numbered(monkeypatch):
    """Graphs that went through the joins which number vertices by tables."""
    met, numbered = set(), queries._numbered
    monkeypatch.setattr(queries, "_numbered", lambda v, e: met.update(r[0] for r in v.select("graph_id").distinct().collect()) or numbered(v, e))
    return met


def want(spark, folder):
    v, e = (x.collect() for x in queries._numbered(*tables.all_graphs(spark, folder)))
    size = {}
    for graph, k in v:
        size[graph] = max(k, size.get(graph, 0))
    return size, {tuple(r) for r in e}


def test_planning_loads_no_pyarrow():
    code = "import sys; from grovespark.sources import datasource as d; d.GraphFiles({'path': '/x'}).writer(None, False); assert not {'pyarrow', 'concurrent.futures'} & set(sys.modules)"
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)
    assert datasource.PART_FILES <= 1000


def test_gr_source_numbers_windows_in_their_rows(spark, folder, numbered):
    size, edges = want(spark, folder)
    numbered.clear()
    got = queries.QUERIES["gr_source"](spark, folder).collect()
    assert {tuple(r) for r in got} == edges and len(got) == len(edges)
    assert len(size) > 20 and len(numbered) == 6 and not any(x.startswith("w") for x in numbered)


def test_gr_source_faults_numbers_windows_in_their_rows(spark, folder, numbered):
    size, edges = want(spark, folder)
    numbered.clear()
    got = queries.QUERIES["gr_source_faults"](spark, folder).collect()
    some = {e[0] for e in edges}
    assert len(got) == len(size) and dict(map(tuple, got)) == {k: n % 2 == 0 and k in some for k, n in size.items()}
    assert len(numbered) == 6


def test_tree_source_numbers_windows_in_their_rows(spark, folder, numbered):
    size, _ = want(spark, folder)
    numbered.clear()
    got = {tuple(r) for r in queries.QUERIES["tree_source"](spark, folder).collect()}
    assert got == {(k, v, v - 1, n) for k, n in size.items() for v in range(1, n + 1)}
    assert len(numbered) == 6
