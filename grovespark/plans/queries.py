"""The registered queries over graphs of the relational tables, and what DuckDB computes for them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from grovespark.functions.loops import new_folder, written
from grovespark.operators import centrality, containment, fixpoint, forms, graph, kernels, reporting, separators, sets, treedepth, verify
from grovespark.plans import tables
from grovespark.sources import datasource, files
from grovespark.plans.tables import GRAPHS_SQL, SETS_SQL


def _on(make, get=tables.all_graphs):
    return lambda spark, d: make(*get(spark, d))


def _least(vertices, k: int = 1):
    low = vertices.groupBy("graph_id").agg(F.slice(F.array_sort(F.collect_set("v")), 1, k).alias("vs"))
    return low.select("graph_id", F.explode("vs").alias("v"))


def _even(vertices):
    return vertices.where("v % 2 = 0")


def _spelled(column):
    return F.array_join(F.col(column).cast("array<string>"), " ").alias(column)


def _rounded(df):
    return df.withColumn("score", F.round("score", 6))


def _bfs_tree(vertices, edges):
    """The breadth-first tree from each graph's least vertex as a graph of its own."""
    found = graph.bfs(vertices, edges, _least(vertices))
    return found.select("graph_id", "v"), found.where("parent IS NOT NULL").select("graph_id", F.least("v", "parent").alias("u"), F.greatest("v", "parent").alias("v"))


def positive(vertices, edges):
    """The graphs with ids one higher: 0 as a parent stands for a root, so it can name no vertex of a tree."""
    return vertices.select("graph_id", (F.col("v") + 1).alias("v")), edges.select("graph_id", (F.col("u") + 1).alias("u"), (F.col("v") + 1).alias("v"))


def _solved(vertices, edges):
    """Solved graphs, and whether their trees pass."""
    vertices, edges = positive(vertices, edges)
    solved = written(kernels.solve(vertices, edges))
    return verify.verify(vertices, edges, kernels.trees(solved), solved.select("graph_id", F.col("td").alias("depth"))).select("graph_id", "ok")


def _below_roots(vertices, edges):
    """Depth of the trees that start with the roots of closed forms, by solving what is left without them."""
    roots = written(treedepth.closed_roots(vertices, edges))
    left = vertices.join(roots.withColumnRenamed("root", "v"), ["graph_id", "v"], "left_anti").join(roots, "graph_id", "left_semi")
    below = kernels.solve(left, graph.induced(edges, left)).select("graph_id", "td")
    return roots.join(below, "graph_id", "left").select("graph_id", (F.coalesce("td", F.lit(0)) + 1).alias("td"))


def _tree_digest(vertices, edges):
    """Depth of each solver's tree, and edges that it does not cover."""
    vertices, edges = positive(vertices, edges)
    return _digest(edges, kernels.trees(written(kernels.solve(vertices, edges))))


def _forest_digest(rows):
    """The same of the forest that the fixpoint's choices make, checked in each graph's row."""
    return verify.digest_of_rows(fixpoint.forests_of_rows(rows))


def _digest(edges, tree):
    up = verify.climb(tree)
    bad = verify.uncovered_edges(edges, tree, up).groupBy("graph_id").agg(F.count("*").alias("uncovered"))
    return verify.tree_depth(tree, up).join(bad, "graph_id", "left").join(verify.is_tree(tree, up), "graph_id").select("graph_id", F.col("depth").cast("int").alias("depth"), F.coalesce("uncovered", F.lit(0)).cast("long").alias("uncovered"), "is_tree")


def _pulled(vertices, edges):
    """Minimal separators by calls of five or more, as they are found."""
    now = separators.Pull.start(vertices, edges)
    found = now.done
    while now.has_next():
        batch, now = now.next(5)
        found = found.unionAll(batch)
    return separators.named(now.graphs, found).select("graph_id", _spelled("sep"))


def _certificates(vertices, edges):
    """Good and bad forests of each graph: all roots, all below the least vertex, a chain, one with a wrong depth, one with a vertex short, and a ring."""
    by = Window.partitionBy("graph_id").orderBy("v")
    whole = Window.partitionBy("graph_id")
    placed = vertices.select("graph_id", F.col("v") + 1, F.lag(F.col("v") + 1).over(by), F.min(F.col("v") + 1).over(whole), F.max(F.col("v") + 1).over(whole), F.count("*").over(whole).cast("int")).toDF("graph_id", "v", "before", "least", "most", "n")
    kinds = {"flat": "0", "star": "if(v = least, 0, least)", "chain": "coalesce(before, 0)", "deep": "coalesce(before, 0)", "short": "coalesce(before, 0)", "ring": "coalesce(before, most)"}
    depth = {"flat": "1", "star": "if(n = 1, 1, 2)", "chain": "n", "deep": "n + 1", "short": "n - 1", "ring": "n"}
    cut = lambda col, k: F.concat_ws("/", col, F.lit(k)).alias("graph_id")
    trees = declared = gv = ge = None
    add = lambda a, b: b if a is None else a.union(b)
    for k in kinds:
        tree = placed.where("v < most OR n = 1") if k == "short" else placed
        trees = add(trees, tree.select(cut("graph_id", k), "v", F.expr(kinds[k]).cast("int").alias("parent")))
        declared = add(declared, placed.select(cut("graph_id", k), F.expr(depth[k]).cast("int").alias("depth")).distinct())
        gv, ge = add(gv, placed.select(cut("graph_id", k), "v")), add(ge, edges.select(cut("graph_id", k), (F.col("u") + 1).alias("u"), (F.col("v") + 1).alias("v")))
    return written(gv), written(ge), written(trees), written(declared)


def _verified(spark, d):
    return verify.verify(*_certificates(*tables.trade_graphs(spark, d))).select("graph_id", "ok", F.coalesce("reason", F.lit("")).alias("reason"))


def _damaged(vertices, edges):
    """The graphs with loops, turned, repeated and unknown ends."""
    more = edges.where("u % 7 = 0").select("graph_id", "u", F.col("u").alias("v")).distinct()
    more = more.union(edges.where("u % 5 = 0").select("graph_id", F.col("v").alias("u"), F.col("u").alias("v"))).union(edges.where("v % 3 = 0"))
    more = more.union(edges.where("v % 11 = 0").select("graph_id", "v", (F.col("v") + 1000000).alias("v2")))
    return vertices.union(vertices.where("v % 4 = 0")), edges.union(more)


def _sets(make, empty=True):
    return lambda spark, d: make(*tables.supplier_sets(spark, d, empty))


def _ascending(spark, d):
    line = tables.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_suppkey").alias("s")))).alias("x"))
    return line.select("l_orderkey", sets.is_ascending(F.col("x.s")).alias("ascending"))


def _inserted(spark, d):
    line = tables.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.col("l_suppkey").cast("int"))).alias("vset"))
    bound = line.select("l_orderkey", F.slice("vset", 1, 2).alias("vset"), F.expr("cast(l_orderkey % 7 AS int)").alias("lb"), F.expr("cast(l_orderkey % 11 + 7 AS int)").alias("ub"), F.col("vset")[0].alias("root"))
    half = lambda k: bound.where(f"l_orderkey % 2 = {k}").drop("l_orderkey")
    return sets.insert(half(0), half(1)).select(_spelled("vset"), "lb", "ub", "root")


def _indexed(spark, d):
    """An index that the stored sets came into by three inserts, what these reported, and the queries."""
    stored, asked = tables.supplier_sets(spark, d)
    index = containment.Index.create(stored.where("set_id % 7 = 1"), new_folder(spark, "index"))
    said = None
    for k in range(3):
        part = index.insert(stored.where(f"pmod(set_id div 2, 3) = {k}")).withColumn("batch", F.lit(k))
        said = part if said is None else said.unionAll(part)
    return index, said, asked


def _numbered(vertices, edges):
    """The graphs with vertices 1 to n."""
    at = vertices.select("graph_id", "v", F.row_number().over(Window.partitionBy("graph_id").orderBy("v")).alias("k"))
    moved = edges.join(at.select("graph_id", F.col("v").alias("u"), F.col("k").alias("a")), ["graph_id", "u"]).join(at.select("graph_id", "v", F.col("k").alias("b")), ["graph_id", "v"])
    return written(at.select("graph_id", F.col("k").alias("v"))), written(moved.select("graph_id", F.col("a").alias("u"), F.col("b").alias("v")))


def _gr_files(spark, d):
    """The nation graphs written as .gr texts and read again."""
    folder = new_folder(spark, "gr")
    files.write_texts(files.gr_text(*_numbered(*tables.trade_graphs(spark, d))), folder)
    return files.read_gr(spark, folder)[1]


def _tree_files(spark, d):
    """Chains over the nation graphs' vertices written as .tree texts and read again."""
    folder = new_folder(spark, "tree")
    vertices = _numbered(*tables.trade_graphs(spark, d))[0]
    chain = vertices.select("graph_id", "v", (F.col("v") - 1).alias("parent"))
    files.write_texts(files.tree_text(chain.groupBy("graph_id").agg(F.max("v").alias("depth")), chain), folder)
    declared, tree = files.read_tree(spark, folder)
    return tree.join(declared, "graph_id").select("graph_id", F.col("v").cast("int").alias("v"), "parent", "depth")


#: Folders that the files of windows and nations are dealt to.
FOLDERS = 4096


def _numbered_rows(spark, d):
    """The windows' and nations' graphs with vertices 1 to n, a row each as the data source writes them; windows are numbered in their rows."""
    windows, pairs = tables.window_orders(spark, d)
    ends = lambda e: F.expr(f"transform(e, x -> cast({e} AS int))")
    rows = tables.numbered_windows(windows).select("graph_id", "n", ends("shiftright(x, 32)").alias("u"), ends("x & 4294967295").alias("v"), F.lit(None).cast("string").alias("fault"))
    return datasource.rows_of(*_numbered(*tables.trade_graphs(spark, d, pairs))).unionByName(rows)


def _gr_source(spark, d, damaged=False):
    """The windows' and nations' graphs written by the data source and read again; damaged: with ends that are no vertices in those of an even number of vertices."""
    datasource.register(spark)
    folder = new_folder(spark, "gr")
    parts, rows = int(spark.conf.get("spark.sql.shuffle.partitions")), _numbered_rows(spark, d)
    if damaged:
        rows = rows.withColumn("v", F.when(F.col("n") % 2 == 0, F.transform("v", lambda x: x + F.col("n"))).otherwise(F.col("v")))
    rows.repartition(parts).write.format("gr").mode("append").option("folders", FOLDERS).save(folder)
    return spark.read.format("gr").option("partitions", parts).load(folder)


def _tree_source(spark, d):
    """Chains over the windows' and nations' vertices, by the data source."""
    datasource.register(spark)
    folder, parts = new_folder(spark, "tree"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = _numbered_rows(spark, d).select("graph_id", F.col("n").alias("depth"))
    chain = n.select("graph_id", "depth", F.expr("transform(sequence(1, depth), k -> k - 1)").alias("parent"), F.lit(None).cast("string").alias("fault"))
    chain.repartition(parts).write.format("tree").mode("append").option("folders", FOLDERS).save(folder)
    rows = spark.read.format("tree").option("partitions", parts).load(folder)
    return rows.select("graph_id", "depth", F.posexplode("parent").alias("k", "parent")).select("graph_id", (F.col("k") + 1).alias("v"), "parent", "depth")


def _timings(make):
    """Reports over made-up timings: orders as solved instances of five runs."""

    def run(spark, d):
        o = tables.table(spark, d, "orders").select("o_orderpriority", "o_custkey", "o_orderkey")
        records = o.selectExpr("o_orderpriority AS run", "cast(o_custkey % 500 AS string) AS instance", "cast(o_orderkey % 23 AS int) - 1 AS td", "cast(o_orderkey % 1024 AS double) / 8 AS seconds")
        return make(records)

    return run


def _by_component(rows):
    return graph.core_components_of_rows(rows, 3).groupBy("graph_id", "component").agg(F.count("*").alias("n"))


def _core(k):
    return _on(lambda rows: graph.core_numbers_of_rows(rows).where(F.col("core") >= k).select("graph_id", "v"), tables.all_rows)


QUERIES = {
    "td_region": _on(treedepth.small_treedepth, tables.region_graphs),
    "td_small_batch": _on(lambda v, e: treedepth.batch_treedepth(*positive(v, e)), tables.order_graphs),
    "canonical_edges": _on(lambda v, e: graph.canonical_edges(graph.adjacency(e), "src", "dst")),
    "adjacency": _on(lambda v, e: graph.adjacency(e)),
    "degree": _on(graph.degrees),
    "neighbourhoods": _on(lambda v, e: graph.neighbourhoods(v, e).select("graph_id", "v", F.array_join(F.col("nb").cast("array<string>"), " ").alias("nb"), F.col("deg").cast("long").alias("deg"))),
    "vertex_set": _on(lambda v, e: graph.vertex_set(_even(v)).select("graph_id", F.array_join(F.col("vset").cast("array<string>"), " ").alias("vset"))),
    "shape_class": _on(graph.shapes),
    "validate": _on(lambda v, e: graph.validate(*_damaged(v, e))),
    "induced_subgraph": _on(lambda v, e: graph.induced(e, _even(v))),
    "components": _on(graph.components),
    "connected_subset": _on(lambda v, e: graph.is_connected(_even(v), e)),
    "without_vertex": _on(lambda v, e: graph.without(v, e, _least(v))),
    "without_vertices": _on(lambda v, e: graph.without(v, e, _least(v, 3))),
    "articulation": _on(kernels.articulation_kernel),
    "articulation_copies": _on(graph.articulation_points, tables.trade_graphs),
    "articulation_rounds": _on(graph.articulation_rounds),
    "copart_articulation": _on(graph.articulation_rounds, tables.copart_graph),
    "copart_blocks": _on(lambda v, e: graph.blocks(v, e)[1].groupBy("graph_id", "block").agg(F.count("*").alias("edges")).groupBy("graph_id", "edges").agg(F.count("*").alias("blocks")), tables.copart_graph),
    "bfs_tree": _on(lambda v, e: graph.bfs(v, e, _least(v))),
    "dfs_tree": _on(kernels.dfs_tree, tables.region_graphs),
    "two_core": _core(2),
    "three_core": _core(3),
    "three_core_components": _on(_by_component, tables.all_rows),
    "copart_degree": _on(graph.degrees, tables.copart_graph),
    "copart_two_core": _on(lambda v, e: graph.k_core(v, e, 2)[1], tables.copart_graph),
    "contract": _on(lambda v, e: graph.contract(v, e, _least(v, 3))[1]),
    "twins": _on(graph.twins),
    "non_dominated": _on(graph.non_dominated),
    "degree_centrality": _on(centrality.degree),
    "betweenness": _on(lambda v, e: _rounded(centrality.betweenness(v, e))),
    "eigenvector8": _on(lambda v, e: _rounded(centrality.eigenvector(v, e))),
    "pagerank8": _on(lambda v, e: _rounded(centrality.pagerank_like(v, e))),
    "set_search": _sets(sets.search),
    "set_size": _sets(lambda s, q: sets.size(s)),
    "has_subset": _sets(sets.has_subset, False),
    "has_superset": _sets(sets.has_superset),
    "set_is_ascending": _ascending,
    "set_insert": _inserted,
    "index_insert": lambda spark, d: _indexed(spark, d)[1],
    "index_search": lambda spark, d: (lambda i: i[0].search(i[2]))(_indexed(spark, d)),
    "index_subsets": lambda spark, d: (lambda i: i[0].subsets(i[2], 2))(_indexed(spark, d)),
    "index_supersets": lambda spark, d: (lambda i: i[0].supersets(i[2]))(_indexed(spark, d)),
    "super_ids": _on(lambda v, e: graph.super_ids(graph.vertex_set(_even(v))).select("graph_id", "id")),
    "gr_files": _gr_files,
    "tree_files": _tree_files,
    "gr_source": lambda spark, d: datasource.tables_of(_gr_source(spark, d))[1],
    "gr_source_faults": lambda spark, d: _gr_source(spark, d, True).select("graph_id", F.col("fault").isNotNull().alias("fault")),
    "tree_source": _tree_source,
    "timings_by_run": _timings(lambda r: _rounded(reporting.by_run(r).withColumnRenamed("mean_s", "score")).withColumnRenamed("score", "mean_s")),
    "timings_mismatches": _timings(lambda r: reporting.mismatches(r).groupBy("run", "instance", "td", "least").agg(F.count("*").alias("n"))),
    "timings_fastest": _timings(reporting.fastest),
    "all_subsets": _sets(sets.all_subsets),
    "all_supersets": _sets(sets.all_supersets),
    "big_subsets": _sets(lambda s, q: sets.all_subsets(s, q, 2)),
    "td_closed_forms": _on(treedepth.closed_forms),
    "td_trivial_bounds": _on(treedepth.trivial_bounds),
    "td_core_lower": _on(treedepth.core_lower, tables.region_graphs),
    "td_greedy_upper": _on(treedepth.greedy_upper, tables.region_graphs),
    "td_tree": lambda spark, d: kernels.tree_treedepth(*_bfs_tree(*tables.region_graphs(spark, d))).select("graph_id", "td"),
    "small_roots": _on(lambda v, e: treedepth.small_roots(v, e).select("graph_id", "n", "td", "root"), tables.order_graphs),
    "closed_roots": _on(_below_roots, tables.order_graphs),
    "core_numbers": _on(graph.core_numbers),
    "copart_core_numbers": _on(graph.core_numbers, tables.copart_graph),
    "td_core_lower_windows": _on(treedepth.core_lower_of_rows, tables.all_rows),
    "td_brute_force": _on(kernels.brute_force, tables.region_graphs),
    "td_fixpoint": _on(treedepth.fixpoint, tables.region_graphs),
    "td_fixpoint_orders": _on(treedepth.fixpoint, tables.order_graphs),
    "fixpoint_forests": _on(lambda v, e: fixpoint.solve(*positive(v, e)).forest()),
    "fixpoint_forests_orders": _on(_forest_digest, tables.order_rows),
    "td_solve": _on(lambda v, e: kernels.solve(v, e).select("graph_id", "n", "td"), tables.region_graphs),
    "solve_trade": _on(lambda v, e: kernels.results(kernels.solve(v, e)), tables.trade_graphs),
    "solve_windows": _on(lambda v, e: kernels.results(forms.solve(*positive(v, e))), tables.window_graphs),
    "td_forms_orders": _on(lambda v, e: forms.solve(*positive(v, e)).select("graph_id", "n", "td"), tables.order_graphs),
    "forms_orders": _on(lambda v, e: forms.forms(v, e).groupBy("graph_id").agg(F.count("*").alias("components"), F.sum(F.size("vs")).alias("n")), tables.order_graphs),
    "elimination_tree": _on(_tree_digest, tables.region_graphs),
    "verify_tree": _verified,
    "verify_solved": _on(_solved, tables.trade_graphs),
    "small_td_table": lambda spark, d: treedepth.small_table(spark).select("n", "edge_mask", "td"),
    "fm_separators_region": _on(lambda v, e: kernels.fully_minimal_separators(v, e).select("graph_id", _spelled("sep")), tables.region_graphs),
    "minimal_separators_region": _on(lambda v, e: kernels.separators(v, e).select("graph_id", _spelled("sep")), tables.region_graphs),
    "automorphism_count": _on(lambda v, e: kernels.automorphism_summary(v, e).select("graph_id", F.col("group_size").cast("long").alias("group_size"), "orbits"), tables.region_graphs),
    "minimal_separators": _on(lambda v, e: kernels.separators(v, e).withColumn("sep", _spelled("sep"))),
    "fm_separators": _on(lambda v, e: kernels.fully_minimal_separators(v, e).withColumn("sep", _spelled("sep"))),
    "separator_rounds": _on(lambda v, e: separators.minimal(v, e).withColumn("sep", _spelled("sep"))),
    "separator_rounds_region": _on(lambda v, e: separators.fully_minimal(v, e).select("graph_id", _spelled("sep")), tables.region_graphs),
    "separator_pull": _on(_pulled, tables.region_graphs),
    "orbits": _on(lambda v, e: kernels.orbits(v, e).drop("generators").withColumn("group_size", F.col("group_size").cast("long")), tables.region_graphs),
    "separator_batches": _on(lambda v, e: kernels.separator_batches(v, e, 2).groupBy("graph_id", "batch").agg(F.count("*").alias("n")), tables.region_graphs),
    "td_window": _on(lambda v, e: kernels.solve(v, e, window=(2, 3)).selectExpr("graph_id", "ub <= 2 AS low", "lb >= 3 AS high"), tables.order_graphs),
    "rooted_bounds": _on(kernels.rooted_bounds, tables.order_graphs),
    "automorphisms": _on(lambda v, e: kernels.automorphisms(v, e).select("graph_id", _spelled("image")), tables.region_graphs),
}

G = "WITH RECURSIVE " + GRAPHS_SQL


def _reach(vertices: str, edges: str, out: str) -> str:
    """CTEs that give (graph_id, v, component) of a graph in two named CTEs."""
    return f""",
reach AS (
  SELECT graph_id, v AS s, v FROM {vertices}
  UNION SELECT r.graph_id, r.s, {edges}.dst FROM reach r JOIN {edges} ON {edges}.graph_id = r.graph_id AND {edges}.src = r.v),
{out} AS (SELECT graph_id, s AS v, min(v) AS component FROM reach GROUP BY 1, 2)"""


def _kept(where: str) -> str:
    return f""",
kv AS (SELECT * FROM (SELECT graph_id, v, row_number() OVER (PARTITION BY graph_id ORDER BY v) AS k FROM gv) WHERE {where}),
ke AS (SELECT adj.* FROM adj JOIN kv a ON a.graph_id = adj.graph_id AND a.v = src JOIN kv b ON b.graph_id = adj.graph_id AND b.v = dst)"""


def _peeled(k: int, rounds: int) -> str:
    """Peeling unrolled; more rounds than any of these graphs needs."""
    out = ", c0 AS (SELECT graph_id, v FROM gv)"
    for i in range(rounds):
        out += f""",
c{i + 1} AS MATERIALIZED (SELECT c.graph_id, c.v FROM c{i} c JOIN adj ON adj.graph_id = c.graph_id AND src = c.v JOIN c{i} d ON d.graph_id = c.graph_id AND d.v = dst GROUP BY 1, 2 HAVING count(*) >= {k})"""
    return out


def _power(damping: float | None) -> str:
    out = ", n AS (SELECT graph_id, count(*) AS n FROM gv GROUP BY 1), x0 AS (SELECT gv.graph_id, v, sqrt(1 / n) AS x FROM gv JOIN n USING (graph_id))"
    for i in range(8):
        term = "coalesce(h, 0)" if damping is None else f"{damping} * coalesce(h, 0) + {1 - damping} * total"
        out += f""",
h{i} AS (SELECT adj.graph_id, dst AS v, sum(x) AS h FROM adj JOIN x{i} x ON x.graph_id = adj.graph_id AND x.v = src GROUP BY 1, 2),
y{i} AS (SELECT x.graph_id, x.v, {term} AS y FROM x{i} x LEFT JOIN h{i} USING (graph_id, v) JOIN (SELECT graph_id, sum(x) AS total FROM x{i} GROUP BY 1) USING (graph_id)),
x{i + 1} AS MATERIALIZED (SELECT graph_id, v, y / sqrt(sum(y * y) OVER (PARTITION BY graph_id)) AS x FROM y{i})"""
    return G + out + " SELECT graph_id, v, round(x, 6) AS score FROM x8"


def _mask_dp(prefix: str, vertices: str, edges: str, where: str = "", greedy: bool = False, most: int = 5) -> str:
    """Treedepth of graphs of at most so many vertices by definition, over masks of vertices by size; fc has the component of each mask's least vertex; greedy: the first vertex of most neighbours goes instead of the best."""
    pick = " JOIN hub ON hub.graph_id = s.graph_id AND hub.mask = s.mask AND hub.i = vi.i" if greedy else ""
    parts = f"""{prefix},
vi AS (SELECT graph_id, v, row_number() OVER (PARTITION BY graph_id ORDER BY v) - 1 AS i FROM {vertices}),
nn AS (SELECT graph_id, count(*) AS n FROM vi GROUP BY 1),
nb AS (SELECT a.graph_id, a.i, bit_or(1 << b.i) AS nb FROM {edges} e JOIN vi a ON a.graph_id = e.graph_id AND a.v = src JOIN vi b ON b.graph_id = e.graph_id AND b.v = dst GROUP BY 1, 2),
m AS (SELECT graph_id, unnest(range(1, 1 << n)) AS mask FROM nn),
fl AS (
  SELECT graph_id, mask, mask & -mask AS c FROM m
  UNION SELECT f.graph_id, f.mask, f.c | coalesce(bit_or(nb & f.mask), 0) FROM fl f LEFT JOIN nb ON nb.graph_id = f.graph_id AND (f.c >> nb.i) & 1 = 1 GROUP BY f.graph_id, f.mask, f.c),
fc AS MATERIALIZED (SELECT graph_id, mask, max(c) AS c FROM fl GROUP BY 1, 2)"""
    if greedy:
        parts += """,
dg AS (SELECT m.graph_id, m.mask, vi.i, bit_count(coalesce(nb.nb, 0) & m.mask) AS d FROM m JOIN vi ON vi.graph_id = m.graph_id AND (m.mask >> vi.i) & 1 = 1 LEFT JOIN nb ON nb.graph_id = vi.graph_id AND nb.i = vi.i),
hub AS MATERIALIZED (SELECT graph_id, mask, i FROM (SELECT *, row_number() OVER (PARTITION BY graph_id, mask ORDER BY d DESC, i) AS k FROM dg) WHERE k = 1)"""
    parts += ", t1 AS (SELECT graph_id, mask, 1 AS t FROM m WHERE bit_count(mask) = 1)"
    for k in range(2, most + 1):
        parts += f""",
s{k} AS (SELECT * FROM fc WHERE bit_count(mask) = {k}),
t{k} AS MATERIALIZED (
  SELECT * FROM t{k - 1}
  UNION ALL SELECT s.graph_id, s.mask, 1 + min(t.t) FROM s{k} s JOIN vi ON vi.graph_id = s.graph_id AND (s.mask >> vi.i) & 1 = 1{pick} JOIN t{k - 1} t ON t.graph_id = s.graph_id AND t.mask = xor(s.mask, (1 << vi.i)::BIGINT) WHERE s.c = s.mask GROUP BY 1, 2
  UNION ALL SELECT s.graph_id, s.mask, greatest(a.t, b.t) FROM s{k} s JOIN t{k - 1} a ON a.graph_id = s.graph_id AND a.mask = s.c JOIN t{k - 1} b ON b.graph_id = s.graph_id AND b.mask = xor(s.mask, s.c) WHERE s.c <> s.mask)"""
    return parts + " SELECT nn.graph_id, nn.n::INT AS n, t.t::INT AS td FROM nn JOIN t" + str(most) + " t ON t.graph_id = nn.graph_id AND t.mask = (1 << nn.n) - 1 JOIN fc ON fc.graph_id = nn.graph_id AND fc.mask = t.mask" + where


REGIONS = G + ", rv AS (SELECT * FROM gv WHERE graph_id LIKE 'region%'), re AS (SELECT * FROM adj WHERE graph_id LIKE 'region%')"
MASKS = """,
vi AS (SELECT graph_id, v, row_number() OVER (PARTITION BY graph_id ORDER BY v) - 1 AS i FROM rv),
nb AS (SELECT a.graph_id, a.i, bit_or(1 << b.i) AS nb FROM re e JOIN vi a ON a.graph_id = e.graph_id AND a.v = src JOIN vi b ON b.graph_id = e.graph_id AND b.v = dst GROUP BY 1, 2),
m AS (SELECT graph_id, unnest(range(1, 32)) AS mask FROM (SELECT DISTINCT graph_id FROM rv))"""
NUMBERED = G + ", num AS (SELECT graph_id, v, row_number() OVER (PARTITION BY graph_id ORDER BY v)::INT AS k FROM gv WHERE graph_id NOT LIKE 'w%')"
TIMINGS = "WITH r AS (SELECT o_orderpriority AS run, (o_custkey % 500)::VARCHAR AS instance, (o_orderkey % 23)::INT - 1 AS td, (o_orderkey % 1024)::DOUBLE / 8 AS seconds FROM orders)"
ORDERS = """WITH RECURSIVE
ol AS (SELECT DISTINCT l_orderkey::VARCHAR AS graph_id, l_suppkey::INT AS v, s_nationkey AS k FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
ov AS (SELECT graph_id, v, k FROM ol),
oe AS MATERIALIZED (SELECT a.graph_id, a.v AS src, b.v AS dst FROM ov a JOIN ov b ON a.graph_id = b.graph_id AND a.v <> b.v AND abs(a.k - b.k) <= 4)"""
#: Suppliers of the largest order.
MOST = 16
COPART = """WITH RECURSIVE
p AS (SELECT DISTINCT l_orderkey AS o, l_partkey::INT AS p FROM lineitem),
pe AS (SELECT 'copart' AS graph_id, a.p AS u, b.p AS v FROM p a JOIN p b ON a.o = b.o AND a.p < b.p GROUP BY 2, 3 HAVING count(*) >= 2),
adj AS (SELECT graph_id, u AS src, v AS dst FROM pe UNION ALL SELECT graph_id, v, u FROM pe),
gv AS (SELECT DISTINCT graph_id, src AS v FROM adj)"""
S = "WITH " + SETS_SQL

SHAPES = """, sh AS (SELECT graph_id, count(*) AS n, (sum(d) // 2)::BIGINT AS m, min(d) AS min_degree, max(d) AS max_degree FROM deg GROUP BY 1),
sc AS (SELECT *, CASE WHEN m = n * (n - 1) // 2 THEN 'complete' WHEN m = n - 1 AND max_degree = n - 1 THEN 'star' WHEN m = n AND max_degree = 2 AND min_degree = 2 THEN 'cycle'
  WHEN m = n - 1 AND max_degree <= 2 THEN 'path' WHEN m = n - 1 THEN 'tree' ELSE 'other' END AS shape FROM sh)"""
BFS = """, walk AS (
  SELECT graph_id, min(v) AS v, 0 AS depth FROM gv GROUP BY 1
  UNION SELECT w.graph_id, dst, depth + 1 FROM walk w JOIN adj ON adj.graph_id = w.graph_id AND src = w.v WHERE depth < 25),
bd AS (SELECT graph_id, v, min(depth) AS depth FROM walk GROUP BY 1, 2)"""
PATHS = """, wk AS (
  SELECT graph_id, v AS s, v AS t, 0 AS d, 1.0::DOUBLE AS p FROM gv
  UNION ALL SELECT graph_id, s, t, d, sum(p) FROM (
    SELECT w.graph_id, w.s, adj.dst AS t, w.d + 1 AS d, w.p FROM wk w JOIN adj ON adj.graph_id = w.graph_id AND adj.src = w.t WHERE w.d < 12) GROUP BY 1, 2, 3, 4),
dist AS (SELECT graph_id, s, t, min(d) AS d FROM wk GROUP BY 1, 2, 3),
sp AS MATERIALIZED (SELECT wk.* FROM wk JOIN dist USING (graph_id, s, t, d)),
bc AS (
  SELECT a.graph_id, a.t AS v, sum(a.p * b.p / c.p) AS score
  FROM sp a JOIN sp b ON b.graph_id = a.graph_id AND b.s = a.t JOIN sp c ON c.graph_id = a.graph_id AND c.s = a.s AND c.t = b.t
  WHERE a.s <> a.t AND b.s <> b.t AND a.s <> b.t AND a.d + b.d = c.d GROUP BY 1, 2)"""

#: All graphs of one to five vertices.
SMALL = """WITH RECURSIVE
mk AS (SELECT n, unnest(range(0, 1 << (n * (n - 1) // 2))) AS em FROM (SELECT unnest([1, 2, 3, 4, 5]) AS n)),
sv AS (SELECT n || '_' || em AS graph_id, n, em, unnest(range(0, n)) AS v FROM mk),
half AS (SELECT a.graph_id, a.v AS a, b.v AS b FROM sv a JOIN sv b ON a.graph_id = b.graph_id AND a.v < b.v WHERE (a.em >> (a.v * (2 * a.n - a.v - 1) // 2 + b.v - a.v - 1)) & 1 = 1),
se AS (SELECT graph_id, a AS src, b AS dst FROM half UNION ALL SELECT graph_id, b, a FROM half)"""

#: Minimal separators by definition: sets of a component that two components beside them see whole.
SEPARATORS = REGIONS + _reach("rv", "re", "comp") + """,
vi AS (SELECT graph_id, v, row_number() OVER (PARTITION BY graph_id ORDER BY v) - 1 AS i, component FROM comp),
masks AS (SELECT DISTINCT graph_id, component, unnest(range(1, 32)) AS mask FROM vi),
sub AS (
  SELECT m.* FROM masks m WHERE NOT EXISTS (SELECT 1 FROM range(0, 5) r(i) LEFT JOIN vi ON vi.graph_id = m.graph_id AND vi.i = r.i AND vi.component = m.component WHERE (m.mask >> r.i) & 1 = 1 AND vi.v IS NULL)),
beside AS (SELECT s.graph_id, s.component, s.mask, vi.v FROM sub s JOIN vi ON vi.graph_id = s.graph_id AND vi.component = s.component AND (s.mask >> vi.i) & 1 = 0),
far AS (
  SELECT graph_id, mask, component, v AS s, v FROM beside
  UNION SELECT f.graph_id, f.mask, f.component, f.s, b.v FROM far f JOIN re ON re.graph_id = f.graph_id AND re.src = f.v JOIN beside b ON b.graph_id = f.graph_id AND b.mask = f.mask AND b.component = f.component AND b.v = re.dst),
parts AS (SELECT graph_id, mask, component, v, min(s) AS part FROM far GROUP BY 1, 2, 3, 4),
sees AS (
  SELECT p.graph_id, p.mask, p.component, p.part, bit_count(p.mask) AS size, count(DISTINCT vi.i) FILTER ((p.mask >> vi.i) & 1 = 1) AS seen
  FROM parts p JOIN re ON re.graph_id = p.graph_id AND re.src = p.v JOIN vi ON vi.graph_id = p.graph_id AND vi.v = re.dst GROUP BY 1, 2, 3, 4, 5),
seps AS (SELECT graph_id, mask, count(*) FILTER (seen = size) AS whole, count(*) AS parts FROM sees GROUP BY 1, 2)
SELECT s.graph_id, string_agg(vi.v::VARCHAR, ' ' ORDER BY vi.v) AS sep FROM seps s JOIN vi ON vi.graph_id = s.graph_id AND (s.mask >> vi.i) & 1 = 1 WHERE whole >= 2 AND {} GROUP BY s.graph_id, s.mask"""

#: Permutations of five vertices that keep every edge.
AUTOMORPHISMS = REGIONS + """,
vi AS (SELECT graph_id, v, row_number() OVER (PARTITION BY graph_id ORDER BY v) - 1 AS i FROM rv),
ei AS (SELECT a.graph_id, a.i, b.i AS j FROM re JOIN vi a ON a.graph_id = re.graph_id AND a.v = src JOIN vi b ON b.graph_id = re.graph_id AND b.v = dst),
r AS (SELECT unnest(range(0, 5)) AS x),
perms AS (
  SELECT [a.x, b.x, c.x, d.x, e.x] AS p FROM r a JOIN r b ON b.x <> a.x JOIN r c ON c.x NOT IN (a.x, b.x) JOIN r d ON d.x NOT IN (a.x, b.x, c.x) JOIN r e ON e.x NOT IN (a.x, b.x, c.x, d.x)),
good AS (
  SELECT g.graph_id, p FROM (SELECT DISTINCT graph_id FROM rv) g, perms
  WHERE NOT EXISTS (SELECT 1 FROM ei e WHERE e.graph_id = g.graph_id AND NOT EXISTS (SELECT 1 FROM ei f WHERE f.graph_id = g.graph_id AND f.i = p[e.i + 1] AND f.j = p[e.j + 1]))),
low AS (SELECT graph_id, x, min(p[x + 1]) AS low FROM good, r GROUP BY 1, 2)
SELECT graph_id, n AS group_size, orbits FROM (SELECT graph_id, count(*) AS n FROM good GROUP BY 1) JOIN (SELECT graph_id, count(DISTINCT low) AS orbits FROM low GROUP BY 1) USING (graph_id)"""

ORACLES = {
    "td_solve": _mask_dp(REGIONS, "rv", "re"),
    "small_td_table": "SELECT n, split_part(graph_id, '_', 2)::BIGINT AS edge_mask, td FROM (" + _mask_dp(SMALL, "sv", "se", " WHERE fc.c = fc.mask") + ")",
    "minimal_separators_region": SEPARATORS.replace("{}", "true"),
    "fm_separators_region": SEPARATORS.replace("{}", "whole = parts"),
    "automorphism_count": AUTOMORPHISMS,
    "td_region": _mask_dp(REGIONS, "rv", "re"),
    "td_small_batch": _mask_dp(ORDERS, "ov", "oe", most=MOST),
    "td_brute_force": "SELECT graph_id, td FROM (" + _mask_dp(REGIONS, "rv", "re") + ")",
    "td_fixpoint": "SELECT graph_id, td FROM (" + _mask_dp(REGIONS, "rv", "re") + ")",
    "canonical_edges": G + " SELECT * FROM ge",
    "adjacency": G + " SELECT * FROM adj",
    "degree": G + " SELECT graph_id, v, d AS degree FROM deg",
    "neighbourhoods": G + " SELECT gv.graph_id, gv.v, coalesce(string_agg(dst::VARCHAR, ' ' ORDER BY dst), '') AS nb, count(dst) AS deg FROM gv LEFT JOIN adj ON adj.graph_id = gv.graph_id AND src = gv.v GROUP BY 1, 2",
    "vertex_set": G + " SELECT graph_id, string_agg(v::VARCHAR, ' ' ORDER BY v) AS vset FROM gv WHERE v % 2 = 0 GROUP BY 1",
    "shape_class": G + SHAPES + " SELECT * FROM sc",
    "validate": G + _reach("gv", "adj", "comp") + """,
x AS (
  SELECT graph_id, u, v FROM ge UNION ALL SELECT DISTINCT graph_id, u, u FROM ge WHERE u % 7 = 0 UNION ALL SELECT graph_id, v, u FROM ge WHERE u % 5 = 0
  UNION ALL SELECT graph_id, u, v FROM ge WHERE v % 3 = 0 UNION ALL SELECT graph_id, v, v + 1000000 FROM ge WHERE v % 11 = 0)
SELECT graph_id, 'connected' AS rule, count(DISTINCT component) AS n FROM comp GROUP BY 1 HAVING count(DISTINCT component) > 1
UNION ALL SELECT graph_id, 'loop', count(*) FROM x WHERE u = v GROUP BY 1
UNION ALL SELECT graph_id, 'order', count(*) FROM x WHERE u > v GROUP BY 1
UNION ALL SELECT graph_id, 'repeated edge', count(*) FROM (SELECT graph_id, u, v FROM x GROUP BY 1, 2, 3 HAVING count(*) > 1) GROUP BY 1
UNION ALL SELECT graph_id, 'repeated vertex', count(*) FROM gv WHERE v % 4 = 0 GROUP BY 1
UNION ALL SELECT graph_id, 'unknown vertex', count(*) FROM (SELECT graph_id, u AS v FROM x UNION ALL SELECT graph_id, v FROM x) WHERE v >= 1000000 GROUP BY 1""",
    "induced_subgraph": G + " SELECT * FROM ge WHERE u % 2 = 0 AND v % 2 = 0",
    "components": G + _reach("gv", "adj", "comp") + " SELECT * FROM comp",
    "connected_subset": G + _kept("v % 2 = 0") + _reach("kv", "ke", "comp") + " SELECT graph_id, count(DISTINCT component) = 1 AS connected FROM comp GROUP BY 1",
    "without_vertex": G + _kept("k > 1") + _reach("kv", "ke", "comp") + " SELECT * FROM comp",
    "without_vertices": G + _kept("k > 3") + _reach("kv", "ke", "comp") + " SELECT * FROM comp",
    "articulation": G + """, rr AS (
  SELECT a.graph_id, a.src AS x, a.dst AS s, a.dst AS v FROM adj a
  UNION SELECT r.graph_id, r.x, r.s, adj.dst FROM rr r JOIN adj ON adj.graph_id = r.graph_id AND adj.src = r.v AND adj.dst <> r.x)
SELECT DISTINCT a.graph_id, a.src AS v FROM adj a JOIN adj b ON a.graph_id = b.graph_id AND a.src = b.src
LEFT JOIN rr ON rr.graph_id = a.graph_id AND rr.x = a.src AND rr.s = a.dst AND rr.v = b.dst WHERE rr.v IS NULL""",
    "bfs_tree": G + BFS + " SELECT b.graph_id, b.v, b.depth, min(p.v) AS parent FROM bd b LEFT JOIN (SELECT bd.*, dst FROM bd JOIN adj ON adj.graph_id = bd.graph_id AND adj.src = bd.v) p ON p.graph_id = b.graph_id AND p.dst = b.v AND p.depth = b.depth - 1 GROUP BY 1, 2, 3",
    "two_core": G + _peeled(2, 25) + " SELECT * FROM c25",
    "three_core": G + _peeled(3, 25) + " SELECT * FROM c25",
    "three_core_components": G + _peeled(3, 25) + ", ce AS (SELECT adj.* FROM adj JOIN c25 a ON a.graph_id = adj.graph_id AND a.v = src JOIN c25 b ON b.graph_id = adj.graph_id AND b.v = dst)" + _reach("c25", "ce", "comp") + " SELECT graph_id, component, count(*) AS n FROM comp GROUP BY 1, 2",
    "copart_degree": COPART + " SELECT graph_id, src AS v, count(*) AS degree FROM adj GROUP BY 1, 2",
    "copart_two_core": COPART + _peeled(2, 40) + " SELECT pe.* FROM pe JOIN c40 a ON a.v = pe.u JOIN c40 b ON b.v = pe.v",
    "contract": G + _kept("k <= 3") + """, low AS (SELECT graph_id, min(v) AS low FROM kv GROUP BY 1),
mv AS (SELECT gv.graph_id, gv.v, CASE WHEN kv.v IS NULL THEN gv.v ELSE low END AS t FROM gv LEFT JOIN kv USING (graph_id, v) JOIN low USING (graph_id))
SELECT DISTINCT ge.graph_id, least(a.t, b.t) AS u, greatest(a.t, b.t) AS v FROM ge JOIN mv a ON a.graph_id = ge.graph_id AND a.v = u JOIN mv b ON b.graph_id = ge.graph_id AND b.v = ge.v WHERE a.t <> b.t""",
    "twins": G + """, ns AS (SELECT gv.graph_id, gv.v, coalesce(list_sort(list(dst) FILTER (dst IS NOT NULL)), []) AS o, list_sort(list_append(coalesce(list(dst) FILTER (dst IS NOT NULL), []), gv.v)) AS c FROM gv LEFT JOIN adj ON adj.graph_id = gv.graph_id AND src = gv.v GROUP BY 1, 2)
SELECT a.graph_id, a.v, min(b.v) AS representative FROM ns a JOIN ns b ON a.graph_id = b.graph_id AND (a.o = b.o OR a.c = b.c) GROUP BY 1, 2""",
    "non_dominated": G + """ SELECT a.graph_id, a.v FROM deg a WHERE NOT EXISTS (
  SELECT 1 FROM deg b WHERE b.graph_id = a.graph_id AND b.v <> a.v AND (a.d < b.d OR (a.d = b.d AND b.v < a.v)) AND NOT EXISTS (
    SELECT 1 FROM adj x WHERE x.graph_id = a.graph_id AND x.src = a.v AND x.dst <> b.v AND NOT EXISTS (
      SELECT 1 FROM adj y WHERE y.graph_id = a.graph_id AND y.src = b.v AND y.dst = x.dst)))""",
    "degree_centrality": G + " SELECT graph_id, v, d::DOUBLE AS score FROM deg",
    "betweenness": G + PATHS + " SELECT gv.graph_id, gv.v, round(coalesce(score, 0), 6) AS score FROM gv LEFT JOIN bc USING (graph_id, v)",
    "eigenvector8": _power(None),
    "pagerank8": _power(0.85),
    "set_search": S + " SELECT query_id, EXISTS (SELECT 1 FROM te WHERE te.word = q.word) AS found FROM q",
    "set_size": S + " SELECT count(DISTINCT word) AS n FROM te",
    "has_subset": S + " SELECT query_id, EXISTS (SELECT 1 FROM m WHERE m.query_id = q.query_id AND n = stored AND stored > 0) AS found FROM q",
    "has_superset": S + " SELECT query_id, EXISTS (SELECT 1 FROM m WHERE m.query_id = q.query_id AND n = asked) AS found FROM q",
    "all_subsets": S + " SELECT query_id, set_id, asked - n AS gap FROM m WHERE n = stored",
    "all_supersets": S + " SELECT query_id, set_id FROM m WHERE n = asked",
    "big_subsets": S + " SELECT query_id, set_id, asked - n AS gap FROM m WHERE n = stored AND asked - n <= 2",
    "set_is_ascending": "SELECT l_orderkey, w = list_sort(list_distinct(w)) AS ascending FROM (SELECT l_orderkey, list(l_suppkey ORDER BY l_linenumber, l_suppkey) AS w FROM lineitem GROUP BY 1)",
    "set_insert": """WITH o AS (SELECT l_orderkey AS o, list_sort(list(DISTINCT l_suppkey::INT)) AS w FROM lineitem GROUP BY 1),
b AS (SELECT w[1:2] AS s, (o % 7)::INT AS lb, (o % 11 + 7)::INT AS ub, w[1] AS root FROM o)
SELECT array_to_string(s, ' ') AS vset, max(lb) AS lb, min(ub) AS ub, min({'u': ub, 'r': root}).r AS root FROM b GROUP BY s""",
    "super_ids": G + " SELECT graph_id, min(v) AS id FROM gv WHERE v % 2 = 0 GROUP BY 1",
    "gr_files": NUMBERED + " SELECT ge.graph_id, a.k AS u, b.k AS v FROM ge JOIN num a ON a.graph_id = ge.graph_id AND a.v = u JOIN num b ON b.graph_id = ge.graph_id AND b.v = ge.v",
    "tree_files": NUMBERED + " SELECT graph_id, k AS v, k - 1 AS parent, max(k) OVER (PARTITION BY graph_id) AS depth FROM num",
    "timings_by_run": TIMINGS + " SELECT run, count(*) AS attempted, count(*) FILTER (td > -1) AS solved, sum(seconds) FILTER (td > -1) AS total_s, round(avg(seconds) FILTER (td > -1), 6) AS mean_s FROM r GROUP BY 1",
    "timings_mismatches": TIMINGS + " SELECT run, instance, td, least, count(*) AS n FROM (SELECT *, min(td) OVER (PARTITION BY instance) AS least FROM r WHERE td > -1) WHERE td <> least GROUP BY 1, 2, 3, 4",
    "timings_fastest": TIMINGS + " SELECT instance, min(td) AS td, min(seconds) AS seconds, min({'s': seconds, 'r': run}).r AS run FROM r WHERE td > -1 GROUP BY 1",
    "td_closed_forms": G + SHAPES + " SELECT graph_id, n, shape, (CASE shape WHEN 'complete' THEN n WHEN 'star' THEN 2 WHEN 'cycle' THEN 1 + ceil(log2(n)) WHEN 'path' THEN ceil(log2(n + 1)) END)::INT AS td FROM sc",
    "td_trivial_bounds": G + SHAPES + " SELECT graph_id, greatest(m // n + 1, min_degree + 1)::BIGINT AS lower, n AS upper FROM sc",
    "verify_tree": G + """, k AS (SELECT graph_id, count(*) AS n, min(v) AS least FROM gv WHERE graph_id NOT LIKE 'w%' GROUP BY 1),
f AS (SELECT k.*, (SELECT count(*) FROM ge WHERE ge.graph_id = k.graph_id) AS m, (SELECT count(*) FROM ge WHERE ge.graph_id = k.graph_id AND u <> least) AS away FROM k)
SELECT graph_id || '/' || kind AS graph_id, reason = '' AS ok, reason FROM (
  SELECT graph_id, unnest(['flat', 'star', 'chain', 'deep', 'short', 'ring']) AS kind, unnest([
    CASE WHEN m > 0 THEN 'edge' ELSE '' END, CASE WHEN away > 0 THEN 'edge' ELSE '' END, '', 'depth', CASE WHEN n > 1 THEN 'vertices' ELSE 'depth' END, 'tree']) AS reason FROM f)""",
    "verify_solved": G + " SELECT DISTINCT graph_id, true AS ok FROM gv WHERE graph_id NOT LIKE 'w%'",
    "dfs_tree": REGIONS + _reach("rv", "re", "comp") + """,
walk AS (
  SELECT graph_id, v, [v] AS path FROM comp WHERE v = component
  UNION ALL SELECT w.graph_id, dst, list_append(path, dst) FROM walk w JOIN re ON re.graph_id = w.graph_id AND src = w.v WHERE NOT list_contains(path, dst)),
best AS (SELECT graph_id, v, max(path) AS path FROM walk GROUP BY 1, 2)
SELECT graph_id, v, CASE WHEN len(path) = 1 THEN 0 ELSE path[len(path) - 1] END::INT AS parent, len(path)::INT AS depth FROM best""",
    "td_core_lower": REGIONS + MASKS + """,
inner_ AS (SELECT m.graph_id, m.mask, min(bit_count(coalesce(nb.nb, 0) & m.mask)) AS k FROM m JOIN vi ON vi.graph_id = m.graph_id AND (m.mask >> vi.i) & 1 = 1 LEFT JOIN nb ON nb.graph_id = vi.graph_id AND nb.i = vi.i GROUP BY 1, 2)
SELECT graph_id, (max(k) + 1)::INT AS lower FROM inner_ GROUP BY 1""",
    "td_greedy_upper": "SELECT graph_id, td AS upper FROM (" + _mask_dp(REGIONS, "rv", "re", greedy=True) + ")",
    "td_tree": "SELECT graph_id, td FROM (" + _mask_dp(REGIONS + BFS.replace("FROM gv", "FROM rv").replace("JOIN adj ON adj", "JOIN re adj ON adj") + """,
up AS (SELECT b.graph_id, b.v, min(adj.dst) AS parent FROM bd b JOIN re adj ON adj.graph_id = b.graph_id AND adj.src = b.v JOIN bd p ON p.graph_id = b.graph_id AND p.v = adj.dst AND p.depth = b.depth - 1 GROUP BY 1, 2),
te AS (SELECT graph_id, v AS src, parent AS dst FROM up UNION ALL SELECT graph_id, parent, v FROM up)""", "bd", "te") + ")",
    "elimination_tree": "SELECT graph_id, td AS depth, 0::BIGINT AS uncovered, true AS is_tree FROM (" + _mask_dp(REGIONS, "rv", "re") + ")",
    "orbits": AUTOMORPHISMS.split("SELECT graph_id, n AS group_size")[0] + "SELECT low.graph_id, a.v, b.v AS representative, n AS group_size FROM low JOIN vi a ON a.graph_id = low.graph_id AND a.i = low.x JOIN vi b ON b.graph_id = low.graph_id AND b.i = low.low JOIN (SELECT graph_id, count(*) AS n FROM good GROUP BY 1) c ON c.graph_id = low.graph_id",
    "automorphisms": AUTOMORPHISMS.split("SELECT graph_id, n AS group_size")[0] + "SELECT good.graph_id, string_agg(vi.v::VARCHAR, ' ' ORDER BY r.x) AS image FROM good, r JOIN vi ON vi.graph_id = good.graph_id AND vi.i = p[r.x + 1] GROUP BY good.graph_id, p",
}
#: Sets come in three inserts; the first row of a word names its entry.
INSERTED = S + """, ins AS (SELECT set_id, word, ((set_id // 2) % 3 + 3) % 3 AS batch FROM te),
ent AS (SELECT *, first_value(set_id) OVER (PARTITION BY word ORDER BY batch, set_id) AS entry FROM ins)"""
ORACLES["index_insert"] = INSERTED + " SELECT set_id, entry, set_id = entry AS new, batch::INT AS batch FROM ent"
ORACLES["index_search"] = INSERTED + " SELECT query_id, entry FROM q LEFT JOIN (SELECT DISTINCT word, entry FROM ent) USING (word)"
ORACLES["index_subsets"] = INSERTED + " SELECT query_id, m.set_id AS entry, asked - n AS gap FROM m JOIN ent ON ent.set_id = m.set_id AND ent.entry = m.set_id WHERE n = stored AND asked - n <= 2"
ORACLES["index_supersets"] = INSERTED + " SELECT query_id, m.set_id AS entry FROM m JOIN ent ON ent.set_id = m.set_id AND ent.entry = m.set_id WHERE n = asked"
ORACLES["articulation_rounds"] = ORACLES["articulation"]
ORACLES["copart_articulation"] = ORACLES["articulation"].replace(G, COPART)
ALL_NUMBERED = G + ", num AS (SELECT graph_id, v, row_number() OVER (PARTITION BY graph_id ORDER BY v)::INT AS k FROM gv)"
ORACLES["gr_source"] = ORACLES["gr_files"].replace(NUMBERED, ALL_NUMBERED)
ORACLES["tree_source"] = ORACLES["tree_files"].replace(NUMBERED, ALL_NUMBERED)
ORACLES["gr_source_faults"] = G + " SELECT gv.graph_id, count(*) % 2 = 0 AND gv.graph_id IN (SELECT graph_id FROM ge) AS fault FROM gv GROUP BY 1"
ORACLES["separator_rounds_region"] = ORACLES["fm_separators_region"]
ORACLES["separator_pull"] = ORACLES["minimal_separators_region"]
ORACLES["td_fixpoint_orders"] = "SELECT graph_id, td FROM (" + ORACLES["td_small_batch"] + ")"
ORACLES["fixpoint_forests_orders"] = "SELECT graph_id, td AS depth, 0::BIGINT AS uncovered, true AS is_tree FROM (" + ORACLES["td_small_batch"] + ")"
ORACLES["separator_batches"] = "SELECT graph_id, (k // 2)::INT AS batch, count(*) AS n FROM (SELECT graph_id, row_number() OVER (PARTITION BY graph_id) - 1 AS k FROM (" + ORACLES["minimal_separators_region"] + ")) GROUP BY 1, 2"
ORACLES["td_window"] = "SELECT graph_id, td <= 2 AS low, td >= 3 AS high FROM (" + ORACLES["td_small_batch"] + ")"
OWN = ORACLES["td_small_batch"].rsplit(" SELECT nn.graph_id", 1)[0] + f""",
own AS (SELECT vi.graph_id, vi.v, vi.i, arg_max(fc.mask, bit_count(fc.mask)) AS mask FROM vi JOIN fc ON fc.graph_id = vi.graph_id AND fc.c = fc.mask AND (fc.mask >> vi.i) & 1 = 1 GROUP BY 1, 2, 3),
rb AS (SELECT own.graph_id, own.v, own.mask, (1 + coalesce(t.t, 0))::INT AS depth FROM own LEFT JOIN t{MOST} t ON t.graph_id = own.graph_id AND t.mask = xor(own.mask, (1 << own.i)::BIGINT))"""
ORACLES["rooted_bounds"] = OWN + " SELECT graph_id, v, depth AS lower, depth AS upper FROM rb"
#: Of the components of the greatest depth the first; of its vertices the first that starts a best tree.
ORACLES["small_roots"] = OWN + """,
cd AS (SELECT graph_id, mask, min(depth) AS td FROM rb GROUP BY 1, 2),
deep AS (SELECT graph_id, max(td) AS td, arg_min(mask, (64 - td)::BIGINT * 4294967296 + (mask & -mask)) AS mask FROM cd GROUP BY 1)
SELECT deep.graph_id, nn.n::INT AS n, deep.td, min(rb.v)::INT AS root FROM deep JOIN nn USING (graph_id) JOIN rb ON rb.graph_id = deep.graph_id AND rb.mask = deep.mask AND rb.depth = deep.td WHERE nn.n <= 5 GROUP BY 1, 2, 3"""
ORACLES["closed_roots"] = OWN + """,
dg AS (SELECT ov.graph_id, ov.v, count(dst) AS d FROM ov LEFT JOIN oe ON oe.graph_id = ov.graph_id AND src = ov.v GROUP BY 1, 2),
sh AS (SELECT graph_id, count(*) AS n, sum(d) // 2 AS m, min(d) AS low, max(d) AS high FROM dg GROUP BY 1),
whole AS (SELECT graph_id, max(depth) AS most, min(depth) AS td, count(DISTINCT mask) AS parts FROM rb GROUP BY 1)
SELECT graph_id, td FROM sh JOIN whole USING (graph_id) WHERE parts = 1 AND (m = n * (n - 1) // 2 OR m = n - 1 OR (m = n AND low = 2 AND high = 2))"""
ORACLES["articulation_copies"] = "SELECT * FROM (" + ORACLES["articulation"] + ") WHERE graph_id NOT LIKE 'w%'"


def _cores(prefix: str, rounds: int, layers: int) -> str:
    """Core numbers by peeling for one k after another, unrolled; more rounds and layers than these graphs need."""
    out, before = prefix, "SELECT graph_id, v FROM gv"
    for k in range(1, layers + 1):
        out += f", p{k}_0 AS ({before})"
        for i in range(rounds):
            out += f""",
p{k}_{i + 1} AS MATERIALIZED (SELECT c.graph_id, c.v FROM p{k}_{i} c JOIN adj ON adj.graph_id = c.graph_id AND src = c.v JOIN p{k}_{i} d ON d.graph_id = c.graph_id AND d.v = dst GROUP BY 1, 2 HAVING count(*) >= {k})"""
        before = f"SELECT * FROM p{k}_{rounds}"
    return out + f", cn AS (SELECT gv.graph_id, gv.v, ({' + '.join(f'(EXISTS (SELECT 1 FROM p{k}_{rounds} p WHERE p.graph_id = gv.graph_id AND p.v = gv.v))::INT' for k in range(1, layers + 1))})::INT AS core FROM gv)"


ORACLES["core_numbers"] = _cores(G, 25, 14) + " SELECT * FROM cn"
#: Any number of layers: neighbours' numbers in falling order, the largest place that holds as much, again and again; more rounds than these graphs need.
ORACLES["copart_core_numbers"] = COPART + """,
it AS (
  SELECT graph_id, src AS v, count(*) AS c, 0 AS t FROM adj GROUP BY 1, 2
  UNION ALL SELECT graph_id, v, max(least(c, k)), t + 1 FROM (
    SELECT adj.graph_id, adj.src AS v, it.c, it.t, row_number() OVER (PARTITION BY adj.graph_id, adj.src ORDER BY it.c DESC) AS k
    FROM it JOIN adj ON adj.graph_id = it.graph_id AND adj.dst = it.v WHERE it.t < 60) GROUP BY graph_id, v, t)
SELECT graph_id, v, c::INT AS core FROM it WHERE t = 60"""
ORACLES["td_core_lower_windows"] = _cores(G, 25, 14) + " SELECT graph_id, (max(core) + 1)::INT AS lower FROM cn GROUP BY 1"
ORACLES["td_forms_orders"] = ORACLES["td_small_batch"]
ORACLES["forms_orders"] = OWN + " SELECT graph_id, count(DISTINCT mask) AS components, count(*) AS n FROM own GROUP BY 1"
