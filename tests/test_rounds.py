"""Operators that run in rounds over tables: against brute force, the kernels, and forests walked by DuckDB."""

import random

import duckdb
import pytest

from grovespark.functions import bitgraph as bg
from grovespark.functions.loops import written
from grovespark.operators import centrality, fixpoint, forms, graph, kernels, separators, verify
from grovespark.plans import queries, tables

SF = "/root/testdata/sf0.001"

#: Ways between the two ends of the graph that many tasks search.
PARALLEL = 7


def batch(spark, graphs):
    """(vertices, edges) of {name: (n, pairs)}, vertices from 1 on."""
    v = [(g, k) for g, (n, _) in graphs.items() for k in range(1, n + 1)]
    e = [(g, min(a, b), max(a, b)) for g, (_, pairs) in graphs.items() for a, b in set(map(tuple, map(sorted, pairs)))]
    return spark.createDataFrame(v, "graph_id string, v int"), spark.createDataFrame(e, "graph_id string, u int, v int")


def some_graphs(seed, most, many=25):
    rng, out = random.Random(seed), {}
    for k in range(many):
        n, p = rng.randint(1, most), rng.random() * 0.4
        out[f"g{k}"] = (n, [(a, b) for a in range(1, n + 1) for b in range(1, a) if rng.random() < p])
    return out


def beside(k):
    """k ways of two vertices each between two ends: a separator of the ends takes one vertex of each way, in any of 2**k manners."""
    return 2 * k + 2, [x for i in range(k) for x in ((1, 3 + 2 * i), (3 + 2 * i, 4 + 2 * i), (4 + 2 * i, 2))]


def checked_by_sql(edges, forest):
    """(graph, depth, uncovered edges) by walking the forest in DuckDB."""
    con = duckdb.connect()
    con.register("e", edges.toPandas())
    con.register("t", forest.toPandas())
    return con.execute("""
WITH RECURSIVE up AS (
  SELECT graph_id, v, v AS a, parent, 1 AS d FROM t
  UNION ALL SELECT up.graph_id, up.v, t.v, t.parent, d + 1 FROM up JOIN t ON t.graph_id = up.graph_id AND t.v = up.parent WHERE d < 1000),
bad AS (
  SELECT graph_id, count(*) AS n FROM e WHERE NOT EXISTS (SELECT 1 FROM up WHERE up.graph_id = e.graph_id AND (up.v = e.u AND up.a = e.v OR up.v = e.v AND up.a = e.u)) GROUP BY 1)
SELECT graph_id, max(d), coalesce(any_value(bad.n), 0) FROM up LEFT JOIN bad USING (graph_id) WHERE parent = 0 GROUP BY 1""").fetchall()


def test_separators_equal_the_kernel(spark, monkeypatch):
    monkeypatch.setattr(separators, "CHUNK", 3)
    v, e = batch(spark, some_graphs(1, 14) | {"ways": beside(4)})
    for mode in ("strict", "leaf_tolerant"):
        want = sorted(map(str, kernels.separators(v, e, mode).collect()))
        assert sorted(map(str, separators.minimal(v, e, mode).collect())) == want and len(want) > 100
    with pytest.raises(ValueError):
        separators.minimal(v, e, "other")


def test_separators_of_one_graph_are_many_tasks_work(spark, monkeypatch):
    monkeypatch.setattr(separators, "CHUNK", 16)
    search = separators.Pull.start(*batch(spark, {"ways": beside(PARALLEL)}))
    n = 0
    while search.has_next():
        front = search.frontier.count()
        new, search = search.next()
        n = max(n, new.count() // 16)
    assert search.done.count() >= 2**PARALLEL and n > 2  # so many chunks of one graph in a round
    sizes = separators.named(search.graphs, search.done).selectExpr("size(sep) AS n").groupBy("n").count().collect()
    assert {r["n"]: r["count"] for r in sizes}[PARALLEL] >= 2**PARALLEL


def test_pulls_go_on_where_they_ended(spark):
    v, e = batch(spark, {"ways": beside(5), "cycle": (6, [(k, k % 6 + 1) for k in range(1, 7)]), "single": (1, []), "star": (6, [(1, k) for k in range(2, 7)])})
    now = separators.Pull.start(v, e)
    found = now.done
    while now.has_next():
        batch_, now = now.next(10)
        assert batch_.count() >= 10 or not now.has_next()
        found = found.unionAll(batch_)
    assert sorted(map(str, found.collect())) == sorted(map(str, now.done.distinct().collect()))
    full = {r["graph_id"]: r["n"] for r in separators.fully_minimal(v, e).groupBy("graph_id").count().toDF("graph_id", "n").collect()}
    assert full["cycle"] == 9 and full["star"] == 1 and "single" not in full
    with pytest.raises(ValueError):
        now.next(0)


def brute_cores(n, pairs):
    nb = bg.build(n + 1, pairs)
    return {v: max(k for k in range(n + 1) if bg.core(nb, (1 << n + 1) - 2, k) >> v & 1) for v in range(1, n + 1)}


@pytest.mark.parametrize("block, heavy", [(20_000, 100_000), (5, 100_000), (7, 3), (1, 0)])
def test_core_numbers(spark, block, heavy):
    graphs = some_graphs(2, 30) | {"path": (40, [(k, k + 1) for k in range(1, 40)]), "alone": (3, [])}
    want = {(g, v, c) for g, x in graphs.items() for v, c in brute_cores(*x).items()}
    assert {tuple(r) for r in graph.core_numbers(*batch(spark, graphs), block, heavy).collect()} == want


def test_core_numbers_of_nothing(spark):
    assert graph.core_numbers(*graph.empty(spark)).isEmpty()


def test_fixpoint_forests_are_optimal(spark):
    graphs = some_graphs(3, 9) | {"ways": beside(4), "wide": (70, [(k, k + 1) for k in range(1, 70)] + [(1, 70), (10, 50)])}
    v, e = batch(spark, graphs)
    solved = fixpoint.solve(v, e)
    td = {r["graph_id"]: r["td"] for r in solved.treedepth().collect()}
    brute = {g: bg.brute_force(bg.build(n, [(a - 1, b - 1) for a, b in x]), (1 << n) - 1) for g, (n, x) in graphs.items() if n <= 10}
    exact = {r["graph_id"]: r["td"] for r in kernels.solve(v, e).collect()}
    assert td == exact and brute.items() <= td.items()
    forest = written(solved.forest())
    assert sorted(checked_by_sql(e, forest)) == sorted((g, t, 0) for g, t in td.items())
    assert forest.count() == v.count() == forest.select("graph_id", "v").distinct().count()


def test_fixpoint_of_windows_and_trade(spark):
    v, e = queries.positive(*tables.all_graphs(spark, SF))
    solved = fixpoint.solve(v, e)
    want = {r["graph_id"]: r["td"] for r in kernels.solve(v, e).collect()}
    assert {r["graph_id"]: r["td"] for r in solved.treedepth().collect()} == want
    assert sorted(checked_by_sql(e, solved.forest())) == sorted((g, t, 0) for g, t in want.items())


def test_fixpoint_of_nothing(spark):
    solved = fixpoint.solve(*graph.empty(spark))
    assert solved.treedepth().isEmpty()


def test_solver_trees_by_sql(spark):
    v, e = queries.positive(*tables.all_graphs(spark, SF))
    solved = written(kernels.solve(v, e))
    assert sorted(checked_by_sql(e, kernels.trees(solved))) == sorted((r["graph_id"], r["td"], 0) for r in solved.collect())


@pytest.mark.parametrize(
    "parents, pairs, ok, depth",
    [
        ([0, 1, 2, 3, 4, 5, 6], [(1, 7), (2, 5)], True, 7),
        ([0, 1, 1, 2, 2, 3, 3], [(1, 7), (4, 2)], True, 3),
        ([0, 1, 1, 2, 2, 3, 3], [(4, 5)], False, 3),
        ([0, 1, 1, 2, 2, 3, 3], [(4, 3)], False, 3),
        ([2, 3, 4, 5, 6, 7, 1], [], False, None),
        ([0, 1, 4, 3, 0, 5, 9], [], False, 2),
        ([0, 0, 1, 2, 3, 4, 5], [(1, 7), (2, 6)], True, 4),
        ([0, 0, 1, 2, 3, 4, 5], [(1, 2)], False, 4),
    ],
)
def test_verification_by_climbing(spark, parents, pairs, ok, depth):
    n = len(parents)
    v = spark.createDataFrame([("g", k) for k in range(1, n + 1)], "graph_id string, v int")
    e = spark.createDataFrame([("g", a, b) for a, b in pairs], "graph_id string, u int, v int")
    tree = spark.createDataFrame([("g", k + 1, p) for k, p in enumerate(parents)], "graph_id string, v int, parent int")
    declared = spark.createDataFrame([("g", depth)], "graph_id string, depth int")
    (row,) = verify.verify(v, e, tree, declared).collect()
    assert row["ok"] == ok and row["actual"] == depth


def test_two_parents_are_no_tree(spark):
    tree = spark.createDataFrame([("g", 1, 0), ("g", 2, 1), ("g", 2, 3), ("g", 3, 1)], "graph_id string, v int, parent int")
    assert not verify.is_tree(tree).first()["is_tree"]


def brute_blocks(n, pairs):
    """Sets of edges: two at a vertex are together if their other ends are connected without it."""
    pairs = sorted({tuple(sorted(p)) for p in pairs})
    nb = bg.build(n + 1, pairs)
    low = {p: p for p in pairs}

    def top(p):
        while low[p] != p:
            p = low[p]
        return p

    for i, p in enumerate(pairs):
        for q in pairs[:i]:
            for x in set(p) & set(q):
                a, b = sum(p) - x, sum(q) - x
                if bg.flood(nb, 1 << a, ((1 << n + 1) - 1) & ~(1 << x)) >> b & 1:
                    low[top(p)] = top(q)
    out = {}
    for p in pairs:
        out.setdefault(top(p), set()).add(p)
    return {frozenset(x) for x in out.values()}


def test_blocks_and_articulation(spark):
    graphs = some_graphs(6, 25) | {"path": (12, [(k, k + 1) for k in range(1, 12)]), "cycle": (11, [(k, k % 11 + 1) for k in range(1, 12)]), "ways": beside(3), "alone": (2, [])}
    graphs["two cycles"] = (7, [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 6), (6, 3), (6, 7)])
    v, e = batch(spark, graphs)
    tree, found = graph.blocks(v, e)
    got = {}
    for r in found.collect():
        got.setdefault((r["graph_id"], r["block"]), set()).add((r["u"], r["v"]))
    assert {(g, frozenset(x)) for (g, _), x in got.items()} == {(g, b) for g, x in graphs.items() for b in brute_blocks(*x)}
    assert tree.count() == v.count() and sum(map(len, got.values())) == e.count()
    want = {tuple(r) for r in kernels.articulation_kernel(v, e).collect()}
    assert {tuple(r) for r in graph.articulation_rounds(v, e).collect()} == want and len(want) > 30
    assert graph.articulation_rounds(*graph.empty(spark)).isEmpty()


@pytest.mark.parametrize("most", [200_000, 10, 1])
def test_components_in_parts(spark, most):
    graphs = some_graphs(9, 40) | {"path": (60, [(k, k + 1) for k in range(1, 60)]), "alone": (2, [])}
    want = set()
    for g, (n, pairs) in graphs.items():
        nb = bg.build(n + 1, pairs)
        want |= {(g, v, bg.bits(c)[0]) for c in bg.components(nb, (1 << n + 1) - 2) for v in bg.bits(c)}
    assert {tuple(r) for r in graph.components(*batch(spark, graphs), most).collect()} == want


@pytest.mark.parametrize("damping", [None, 0.85])
def test_power_steps_in_rows_and_in_rounds(spark, damping):
    v, e = batch(spark, some_graphs(10, 30) | {"alone": (3, [])})
    spelled = lambda df: {(r["graph_id"], r["v"]): round(r["score"], 9) for r in df.collect()}
    whole = spelled(centrality._power(v, e, 11, damping))
    assert whole == spelled(centrality._power_rounds(v, e, 11, damping)) == spelled(centrality._power(v, e, 11, damping, 20))
    assert len(whole) == v.count()


@pytest.mark.parametrize("partners", [10_000, 1])
def test_domination_by_definition(spark, partners):
    graphs = some_graphs(12, 16, 40) | {"star": (9, [(1, k) for k in range(2, 10)] + [(3, 4), (5, 6)]), "ways": beside(3), "alone": (4, [(1, 2)]), "none": (3, []), "complete": (5, [(a, b) for a in range(1, 6) for b in range(1, a)])}
    graphs["hubs"] = (14, [(h, v) for v in range(4, 15) for h in (1, 2, 3) if v >> (h - 1) & 1])
    v, e = batch(spark, graphs)
    for some in (None, v.where("v % 3 != 0")):
        want = set()
        for g, (n, pairs) in graphs.items():
            nb = bg.build(n + 1, pairs)
            own = [x for x in range(1, n + 1) if some is None or x % 3]
            over = lambda x, w: not nb[x] & ~(1 << w) & ~nb[w] and (nb[w].bit_count(), -w) > (nb[x].bit_count(), -x)  # noqa: B023, E731
            want |= {(g, x) for x in own if not any(w != x and over(x, w) for w in own)}
        assert {tuple(r) for r in graph.non_dominated(v, e, some, partners).collect()} == want
    assert graph.non_dominated(*graph.empty(spark)).isEmpty()


@pytest.mark.parametrize("seed", range(30))
def test_equal_graphs_have_equal_forms(seed):
    rng = random.Random(seed)
    n, p = rng.randint(1, 12), rng.random() * 0.7
    pairs = [(a, b) for a in range(n) for b in range(a) if rng.random() < p]
    if seed % 5 == 0:  # cliques that share vertices, as in the tables
        pairs = [(a, b) for x in [rng.sample(range(n), min(n, 4)) for _ in range(4)] for a in x for b in x if a != b]
    turn = rng.sample(range(n), n)
    one, two = bg.build(n, pairs), bg.build(n, [(turn[a], turn[b]) for a, b in pairs])
    whole = (1 << n) - 1
    spelled = lambda nb: sorted(bg.canonical(nb, c, 10**6)[0] for c in bg.components(nb, whole))
    assert spelled(one) == spelled(two)
    for c in bg.components(one, whole):
        form, order = bg.canonical(one, c, 1 + seed % 3)
        back = bg.of_form(form)
        assert sorted(order) == list(bg.bits(c)) and all((back[i] >> j & 1) == (one[v] >> w & 1) for i, v in enumerate(order) for j, w in enumerate(order))


def test_forms_of_all_small_graphs():
    """As many forms as there are connected graphs of five vertices."""
    pairs = [(a, b) for a in range(5) for b in range(a)]
    graphs = [bg.build(5, [p for k, p in enumerate(pairs) if x >> k & 1]) for x in range(1 << 10)]
    assert len({bg.canonical(nb, 31)[0] for nb in graphs if len(bg.components(nb, 31)) == 1}) == 21


def test_each_form_is_solved_once(spark):
    v, e = queries.positive(*tables.all_graphs(spark, SF))
    orders = written(forms.forms(*tables.order_graphs(spark, SF)))
    assert forms.solve_forms(orders).count() == orders.select("form").distinct().count() < orders.count() / 20
    got = written(forms.solve(v, e))
    plain = lambda df: {r["graph_id"]: (r["n"], r["m"], r["lb"], r["ub"], r["td"], r["status"]) for r in df.collect()}
    assert plain(got) == plain(kernels.solve(v, e))
    assert sorted(checked_by_sql(e, kernels.trees(got))) == sorted((r["graph_id"], r["td"], 0) for r in got.collect())
    assert forms.solve(*graph.empty(spark)).isEmpty()
