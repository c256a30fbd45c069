"""Graph operators on small graphs with known answers (vertices from 1)."""

import pytest
from pyspark.sql import functions as F

from grovespark.operators import centrality, graph, kernels, reporting, sets, treedepth, verify
from grovespark.sources import files

GRAPHS = {
    "doc": "1-2 1-3 3-4 2-4 4-5 4-6 5-6",
    "two_core": "1-2 2-3 3-1 3-4 4-5 5-6 6-7 7-4 6-8 7-9 9-10 10-11",
    "three_core": "1-2 2-3 3-1 3-4 4-5 5-6 6-7 7-4 6-8 7-9 9-10 10-11 4-6 5-7",
    "star": "1-2 1-3 1-4 1-5 1-6",
    "cycle": "1-2 2-3 3-4 4-5 5-6 6-1",
    "c4_leaves": "1-2 2-3 3-4 4-1 3-5 4-6",
    "k23": "1-4 1-5 2-4 2-5 3-4 3-5",
    "l7": "1-2 2-3 3-4 4-5 5-6 6-7",
    "k6": "1-2 1-3 1-4 1-5 1-6 2-3 2-4 2-5 2-6 3-4 3-5 3-6 4-5 4-6 5-6",
    "paw": "1-2 2-3 3-1 1-4",
}
TD = {"doc": 3, "star": 2, "cycle": 4, "l7": 3, "k6": 6}


@pytest.fixture(scope="module")
def batch(spark):
    rows = [(g, *map(int, e.split("-"))) for g, es in GRAPHS.items() for e in es.split()]
    edges = graph.canonical_edges(spark.createDataFrame(rows, "graph_id string, u int, v int")).cache()
    return graph.vertices_of(edges).cache(), edges


def by_graph(df, *cols):
    out = {}
    for r in df.collect():
        out.setdefault(r["graph_id"], []).append(tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]])
    return {k: sorted(v) for k, v in out.items()}


def test_articulation_and_cores(batch):
    points = by_graph(graph.articulation_points(*batch), "v")
    assert points["two_core"] == points["three_core"] == [3, 4, 6, 7, 9, 10]
    assert points["c4_leaves"] == [3, 4] and "cycle" not in points
    assert points == by_graph(kernels.articulation_kernel(*batch), "v")
    v, e = graph.k_core(*batch, 2)
    assert len(by_graph(v, "v")["two_core"]) == 7 and len(by_graph(e, "u")["two_core"]) == 8
    v, e = graph.k_core(*batch, 3)
    assert len(by_graph(v, "v")["three_core"]) == 4 and len(by_graph(e, "u")["three_core"]) == 6


def test_separators(batch):
    count = {k: len(x) for k, x in by_graph(kernels.fully_minimal_separators(*batch), "sep").items()}
    assert count["star"] == 1 and count["cycle"] == 9 and count["c4_leaves"] == 2 and count["two_core"] == 6
    loose = {k: len(x) for k, x in by_graph(kernels.fully_minimal_separators(*batch, mode="leaf_tolerant"), "sep").items()}
    assert loose["c4_leaves"] == 4
    with pytest.raises(ValueError):
        kernels.separators(*batch, mode="other")


def test_contract_and_twins(spark, batch):
    vertices, edges = batch
    pick = lambda *vs: spark.createDataFrame([("c4_leaves", v) for v in vs], "graph_id string, v int")
    v, e = graph.contract(vertices.where("graph_id = 'c4_leaves'"), edges.where("graph_id = 'c4_leaves'"), pick(1, 2))
    assert (v.count(), e.count()) == (5, 5)
    v, e = graph.contract(v, e, pick(3, 4))
    assert (v.count(), e.count()) == (4, 3)
    v, _ = graph.without_twins(vertices, edges)
    assert len(by_graph(v, "v")["star"]) == 2


def test_centralities(batch):
    near = lambda xs, ys: all(abs(a - b) < 1e-5 for a, b in zip(xs, ys, strict=True))
    of = lambda df, g: [s for _, s in by_graph(df, "v", "score")[g]]
    b = centrality.betweenness(*batch)
    assert near(of(b, "k23"), [2 / 3, 2 / 3, 2 / 3, 3, 3]) and near(of(b, "l7"), [0, 10, 16, 18, 16, 10, 0])
    e = centrality.eigenvector(*batch)
    assert near(of(e, "k23"), [0.447214] * 5) and near(of(e, "l7"), [0.198929, 0.339350, 0.479770, 0.479770, 0.479770, 0.339350, 0.198929])
    p = centrality.pagerank_like(*batch)
    assert near(of(p, "k23"), [0.417354] * 3 + [0.488594] * 2)
    assert near(of(p, "l7"), [0.280225, 0.385237, 0.423672, 0.432593, 0.423672, 0.385237, 0.280225])


def test_symmetry(batch):
    found = {r["graph_id"]: (r["orbits"], r["group_size"]) for r in kernels.automorphism_summary(*batch).collect()}
    assert found["k6"] == (1, 720) and found["paw"] == (3, 2)
    assert sorted({x for _, x in by_graph(kernels.orbits(*batch), "v", "representative")["paw"]}) == [1, 2, 4]


def test_solver_trees_and_bounds(batch):
    solved = kernels.solve(*batch).cache()
    td = {r["graph_id"]: r["td"] for r in solved.collect()}
    assert TD.items() <= td.items()
    assert all(verify.verify(*batch, kernels.trees(solved), solved.select("graph_id", F.col("td").alias("depth"))).select("ok").toPandas()["ok"])
    assert {r["graph_id"]: r["td"] for r in treedepth.fixpoint(*batch).collect()} == td
    assert {r["graph_id"]: r["td"] for r in kernels.brute_force(*batch).collect()} == td
    for bounds in (treedepth.trivial_bounds(*batch), treedepth.core_lower(*batch), treedepth.greedy_upper(*batch)):
        for r in bounds.collect():
            assert r.asDict().get("lower", 0) <= td[r["graph_id"]] <= r.asDict().get("upper", 99)
    for r in treedepth.closed_forms(*batch).where("td IS NOT NULL").collect():
        assert r["td"] == td[r["graph_id"]]


def test_small_table(spark):
    rows = {(r["n"], r["td"]): r["k"] for r in treedepth.small_table(spark).groupBy("n", "td").agg(F.count("*").alias("k")).collect()}
    assert rows == {(1, 1): 1, (2, 2): 1, (3, 2): 3, (3, 3): 1, (4, 2): 4, (4, 3): 33, (4, 4): 1, (5, 2): 5, (5, 3): 425, (5, 4): 297, (5, 5): 1}


@pytest.mark.parametrize(
    "parents, depth, ok",
    [("0,1,1,2,3", 3, True), ("0,1,1,1,1", 2, False), ("2,1,1,2,1", 3, False), ("2,3,4,5,1", 5, False), ("0,1,1,2,3", 4, False), ("0,1,1,2", 3, False)],
)
def test_verifier(spark, parents, depth, ok):
    edges = spark.createDataFrame([("g", *p) for p in [(1, 2), (1, 3), (2, 4), (3, 5), (1, 4), (1, 5)]], "graph_id string, u int, v int")
    tree = spark.createDataFrame([("g", v, int(p)) for v, p in enumerate(parents.split(","), 1)], "graph_id string, v int, parent int")
    declared = spark.createDataFrame([("g", depth)], "graph_id string, depth int")
    assert verify.verify(graph.vertices_of(edges), edges, tree, declared).first()["ok"] == ok


def test_forest_is_accepted(spark):
    edges = spark.createDataFrame([("g", 1, 2), ("g", 3, 4)], "graph_id string, u int, v int")
    tree = spark.createDataFrame([("g", 1, 0), ("g", 2, 1), ("g", 3, 0), ("g", 4, 3)], "graph_id string, v int, parent int")
    assert verify.verify(graph.vertices_of(edges), edges, tree, spark.createDataFrame([("g", 2)], "graph_id string, depth int")).first()["ok"]


def test_containment(spark):
    words = [[1, 20, 50], [5, 8, 15], [5], [5, 8], [8, 15], [5, 7, 8, 9, 15]]
    stored = spark.createDataFrame(list(enumerate(words)), "set_id long, word array<int>")
    asked = spark.createDataFrame([(0, [5, 7, 8, 9, 15]), (1, [8]), (2, []), (3, [5, 20]), (4, [1, 20, 50])], "query_id long, word array<int>")
    gaps = sorted((r["set_id"], r["gap"]) for r in sets.all_subsets(stored, asked).where("query_id = 0").collect())
    assert gaps == [(1, 2), (2, 4), (3, 3), (4, 3), (5, 0)]
    assert sets.all_subsets(stored, asked, 2).where("query_id = 0").count() == 2
    assert sets.all_supersets(stored, asked).where("query_id = 1").count() == 4
    assert {r["query_id"]: r["found"] for r in sets.has_superset(stored, asked).collect()} == {0: True, 1: True, 2: True, 3: False, 4: True}
    assert {r["query_id"]: r["found"] for r in sets.has_subset(stored, asked).collect()} == {0: True, 1: False, 2: False, 3: True, 4: True}
    assert {r["query_id"]: r["found"] for r in sets.search(stored, asked).collect()} == {0: True, 1: False, 2: False, 3: False, 4: True}


def test_files_round_trip(spark, batch, tmp_path):
    (tmp_path / "good.gr").write_text("c a comment\r\np tdp 4 3\r\n1 2\r\n2 3\r\n3 4\r\n")
    (tmp_path / "short.gr").write_text("p tdp 11 10\n" + "".join(f"{i} {i + 1}\n" for i in range(1, 9)) + "10 11\n")
    v, e = files.read_gr(spark, str(tmp_path / "good.gr"))
    assert (v.count(), e.count()) == (4, 3)
    with pytest.raises(Exception, match="malformed"):
        files.read_gr(spark, str(tmp_path / "short.gr"))[0].count()
    v, e = files.read_gr(spark, str(tmp_path / "short.gr"), "PERMISSIVE")
    assert kernels.solve(v, e).first()["td"] == 4
    assert [tuple(r) for r in files.malformed(spark, str(tmp_path)).collect()] == [("short", 10, 9)]
    solved = kernels.solve(*batch)
    declared, tree = solved.select("graph_id", F.col("td").alias("depth")), kernels.trees(solved)
    for name, texts in (("tree", files.tree_text(declared, tree)), ("gr", files.gr_text(*batch))):
        for r in texts.collect():
            (tmp_path / f"{r['graph_id']}.out.{name}").write_text(r["value"])
    depth, back = files.read_tree(spark, [str(p) for p in tmp_path.glob("*.out.tree")])
    assert depth.count() == len(GRAPHS) and back.count() == tree.count()
    v, e = files.read_gr(spark, [str(p) for p in tmp_path.glob("*.out.gr")])
    assert (v.count(), e.count()) == (batch[0].count(), batch[1].count())


def test_random_trees_and_reports(spark):
    v, e = files.random_trees(spark, 5, 30, 3)
    assert kernels.tree_treedepth(v, e).count() == 5 and graph.validate(v, e).isEmpty()
    records = spark.createDataFrame([("a", "x", 3, 1.0), ("a", "y", -1, 9.0), ("b", "x", 4, 0.5)], "run string, instance string, td int, seconds double")
    assert {(r["run"], r["attempted"], r["solved"]) for r in reporting.by_run(records).collect()} == {("a", 2, 1), ("b", 1, 1)}
    assert [r["run"] for r in reporting.mismatches(records).collect()] == ["b"]


def test_empty_batch(spark):
    empty = graph.empty(spark)
    assert graph.components(*empty).isEmpty() and kernels.solve(*empty).isEmpty() and graph.k_core(*empty, 2)[0].isEmpty()


def test_stream(spark, tmp_path):
    from grovespark.streaming.incremental import solve_stream

    schema = "graph_id string, edges array<struct<u: int, v: int>>"
    spark.createDataFrame([("a", [(1, 2), (2, 3)]), ("b", [(1, 2)])], schema).write.parquet(str(tmp_path / "in"))
    q = solve_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert {(r["graph_id"], r["td"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("a", 2), ("b", 2)}


def test_stream_keeps_graphs_without_edges(spark, tmp_path):
    from grovespark.streaming.incremental import solve_stream

    schema = "graph_id string, edges array<struct<u: int, v: int>>, vertices array<int>"
    spark.createDataFrame([("a", [(1, 2)], [1, 2, 3]), ("b", [], [7]), ("c", None, [1, 2])], schema).write.parquet(str(tmp_path / "in"))
    q = solve_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert {(r["graph_id"], r["n"], r["td"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("a", 3, 2), ("b", 1, 1), ("c", 2, 1)}


def test_empty_sets(spark):
    stored = spark.createDataFrame([(1, []), (2, [3]), (3, [3, 4]), (4, [])], "set_id long, word array<int>")
    asked = spark.createDataFrame([(10, []), (11, [3]), (12, [9])], "query_id long, word array<int>")
    pairs = lambda df: sorted((r["query_id"], r["set_id"]) for r in df.collect())
    assert pairs(sets.all_subsets(stored, asked)) == [(10, 1), (10, 4), (11, 1), (11, 2), (11, 4), (12, 1), (12, 4)]
    assert pairs(sets.all_supersets(stored, asked)) == [(10, 1), (10, 2), (10, 3), (10, 4), (11, 2), (11, 3)]
    assert pairs(sets.all_subsets(stored, asked, 0)) == [(10, 1), (10, 4), (11, 2)]
    full = stored.where("size(word) > 0")
    assert {r["query_id"]: r["found"] for r in sets.has_subset(full, asked).collect()} == {10: False, 11: True, 12: False}
    assert {r["query_id"]: r["found"] for r in sets.has_superset(stored, asked).collect()} == {10: True, 11: True, 12: False}


def test_roots_start_best_trees(spark, batch):
    """Without its root, a graph is one shallower."""
    vertices, edges = batch
    td = {r["graph_id"]: r["td"] for r in kernels.solve(vertices, edges).collect()}
    small = treedepth.small_roots(vertices, edges)
    for found in (treedepth.closed_roots(vertices, edges), small):
        removed = found.select("graph_id", F.col("root").cast("int").alias("v"))
        kept = vertices.join(removed, ["graph_id", "v"], "left_anti")
        rest = {r["graph_id"]: r["td"] for r in kernels.solve(kept, graph.induced(edges, kept)).collect()}
        names = [r["graph_id"] for r in removed.select("graph_id").collect()]
        assert names and all(rest[g] == td[g] - 1 for g in names if td[g] > 1)
    assert {"star", "cycle", "l7", "k6"} <= {r["graph_id"] for r in treedepth.closed_roots(vertices, edges).collect()}


def test_names_of_contracted_sets_and_merged_bounds(spark):
    bounds = "vset array<int>, lb int, ub int, root int"
    one, two = spark.createDataFrame([([1, 2], 1, 9, 1), ([3], 1, 1, 3)], bounds), spark.createDataFrame([([1, 2], 2, 8, 2), ([4], 1, 1, 4)], bounds)
    assert sorted(tuple(r) for r in sets.insert(one, two).collect()) == [([1, 2], 2, 8, 2), ([3], 1, 1, 3), ([4], 1, 1, 4)]
    named = graph.super_ids(spark.createDataFrame([("g", [2, 5]), ("g", [3])], "graph_id string, vset array<int>"))
    assert sorted(r["id"] for r in named.collect()) == [2, 3]
    words = spark.createDataFrame([([1, 2],), ([2, 1],), ([1, 1],), ([],)], "w array<int>")
    assert [r[0] for r in words.select(sets.is_ascending(F.col("w"))).collect()] == [True, False, False, True]


def test_betweenness_in_turns(batch):
    whole, turns = (by_graph(centrality.betweenness(*batch, sources=k), "v", "score") for k in (256, 3))
    assert all(abs(a - b) < 1e-9 for g in whole for (_, a), (_, b) in zip(whole[g], turns[g], strict=True))


def test_long_chain_is_verified_in_few_rounds(spark):
    n = 300
    edges = spark.range(1, n).selectExpr("'g' AS graph_id", "cast(id AS int) AS u", "cast(id + 1 AS int) AS v")
    chain = spark.range(1, n + 1).selectExpr("'g' AS graph_id", "cast(id AS int) AS v", "cast(id - 1 AS int) AS parent")
    declared = spark.createDataFrame([("g", n)], "graph_id string, depth int")
    assert verify.verify(graph.vertices_of(edges), edges, chain, declared).first()["ok"]
    ring = chain.withColumn("parent", F.expr(f"if(v = 1, {n}, parent)"))
    assert verify.verify(graph.vertices_of(edges), edges, ring, declared).first()["reason"] == "tree"
