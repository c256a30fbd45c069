"""Treedepth in tables: closed forms, the table of small graphs, bounds, and the fixpoint over vertex sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovespark.functions import bitgraph as bg
from grovespark.functions.loops import written
from grovespark.operators import fixpoint as states
from grovespark.operators import forms, graph, kernels

SMALL = 5


def closed_forms(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, td) of complete graphs, stars, cycles and paths; td is null for other shapes."""
    n = F.col("n")
    log = lambda x: F.floor(F.log2(x.cast("double"))).cast("long")  # noqa: E731  exact below 2^48
    td = F.when(F.col("shape") == "complete", n).when(F.col("shape") == "star", F.lit(2)).when(F.col("shape") == "cycle", log(n - 1) + 2).when(F.col("shape") == "path", log(n) + 1)
    return graph.shapes(vertices, edges).select("graph_id", "n", "shape", td.cast("int").alias("td"))


def small_table(spark: SparkSession, most: int = SMALL, connected: bool = True) -> DataFrame:
    """(n, edge_mask, td, root) of every connected (or else every) graph of 1 to most vertices; bit k is the k-th pair in lexicographic order.

    Masks come from a range and are solved by definition where they lie, so the table scales with tasks.
    """
    import pyarrow as pa

    sizes = None
    for n in range(1, most + 1):
        part = spark.range(1 << (n * (n - 1) // 2)).select(F.lit(n).alias("n"), F.col("id").alias("edge_mask"))
        sizes = part if sizes is None else sizes.union(part)

    def run(batches):
        for batch in batches:
            out = []
            for n, mask in zip(*(batch.column(c).to_pylist() for c in ("n", "edge_mask"))):
                pairs = [(u, v) for u in range(n) for v in range(u + 1, n)]
                nb, whole = bg.build(n, [p for k, p in enumerate(pairs) if mask >> k & 1]), (1 << n) - 1
                parts = bg.components(nb, whole)
                if len(parts) == 1 or not connected:
                    memo: dict[int, int] = {}
                    td = bg.brute_force(nb, whole, memo)
                    deep = next(c for c in parts if bg.brute_force(nb, c, memo) == td)
                    root = next(v for v in bg.bits(deep) if 1 + bg.brute_force(nb, deep & ~(1 << v), memo) == td)
                    out.append((n, mask, td, root))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.int32(), pa.int32()))], names=["n", "edge_mask", "td", "root"])

    return sizes.mapInArrow(run, "n int, edge_mask long, td int, root int")


def edge_masks(vertices: DataFrame, edges: DataFrame, most: int = SMALL) -> DataFrame:
    """(graph_id, n, edge_mask) of graphs of at most most vertices, these numbered in order."""
    ids = vertices.groupBy("graph_id").agg(F.array_sort(F.collect_set("v")).alias("vs")).where(F.size("vs") <= most).select("graph_id", "vs", F.size("vs").alias("n"))
    placed = edges.join(ids, "graph_id").select("graph_id", "n", (F.array_position("vs", F.col("u")) - 1).alias("a"), (F.array_position("vs", F.col("v")) - 1).alias("b"))
    masks = placed.groupBy("graph_id").agg(F.bit_or(F.expr("shiftleft(1L, cast(a * (2 * n - a - 1) / 2 + b - a - 1 AS int))")).alias("edge_mask"))
    return ids.join(masks, "graph_id", "left").select("graph_id", "n", F.coalesce("edge_mask", F.lit(0)).cast("long").alias("edge_mask"))


def small_treedepth(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, n, td) of graphs of at most SMALL vertices by the table of all of them, which has 1099 rows and is broadcast."""
    return small_roots(vertices, edges).drop("root")


def batch_treedepth(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, n, td) of graphs of any size: those of at most SMALL vertices by the table, the others by the solver, each form of a component once. Ids are from 1 on."""
    size = vertices.groupBy("graph_id").agg(F.count_distinct("v").alias("n"))
    large = size.where(F.col("n") > SMALL).select("graph_id")
    part = lambda df, how: df.join(large, "graph_id", how)
    solved = forms.solve(part(vertices, "left_semi"), part(edges, "left_semi")).select("graph_id", "n", "td")
    return small_treedepth(part(vertices, "left_anti"), part(edges, "left_anti")).unionByName(solved)


def small_roots(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """small_treedepth with root, the least vertex that some best tree of the deepest component may start with."""
    ids = vertices.groupBy("graph_id").agg(F.array_sort(F.collect_set("v")).alias("vs"))
    found = edge_masks(vertices, edges).join(F.broadcast(small_table(vertices.sparkSession, connected=False)), ["n", "edge_mask"])
    return found.join(ids, "graph_id").select("graph_id", "n", "td", F.get("vs", F.col("root")).alias("root"))


def closed_roots(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, root) of the connected graphs that closed_forms or the ranking of trees answers: a vertex to start a best tree with.

    Any vertex of a complete graph or a cycle (the least), the hub of a star, the middle of a path; of
    other trees the one of highest rank.
    """
    named = closed_forms(vertices, edges).join(graph.is_connected(vertices, edges).where("connected"), "graph_id")
    top = graph.degrees(vertices, edges).groupBy("graph_id").agg(F.min("v").alias("least"), F.max(F.struct("degree", (-F.col("v")).alias("k"))).alias("hub"))
    simple = named.join(top, "graph_id").where(F.col("shape").isin("complete", "cycle", "star")).select("graph_id", F.when(F.col("shape") == "star", -F.col("hub.k")).otherwise(F.col("least")).cast("int").alias("root"))
    trees = named.where(F.col("shape").isin("path", "tree")).select("graph_id")
    ranked = kernels.tree_treedepth(vertices.join(trees, "graph_id", "left_semi"), edges.join(trees, "graph_id", "left_semi"))
    return simple.union(ranked.select("graph_id", "root"))


def trivial_bounds(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, lower, upper): from edges per vertex and the least degree; the number of vertices."""
    s = graph.shapes(vertices, edges)
    return s.select("graph_id", F.greatest(F.floor(F.col("m") / F.col("n")) + 1, F.col("min_degree") + 1).cast("long").alias("lower"), F.col("n").alias("upper"))


def greedy_upper(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, upper): depth of the forest that takes the vertex of most neighbours (then the least) off each component, round by round, for all graphs together."""
    left, links = written(vertices.select("graph_id", "v").distinct()), written(edges)
    upper, depth = None, 0
    while not left.isEmpty():
        depth += 1
        here = left.select("graph_id").distinct().withColumn("upper", F.lit(depth))
        upper = written(here if upper is None else upper.union(here).groupBy("graph_id").agg(F.max("upper").alias("upper")))
        parts = graph.components(left, links)
        hubs = graph.degrees(left, links).join(parts, ["graph_id", "v"]).groupBy("graph_id", "component").agg(F.max(F.struct("degree", (-F.col("v")).alias("k"))).alias("top"))
        left = written(left.join(hubs.select("graph_id", (-F.col("top.k")).cast("int").alias("v")), ["graph_id", "v"], "left_anti"))
        links = written(graph.induced(links, left))
    return upper


def core_lower(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, lower): one more than the largest k with a k-core."""
    return graph.core_numbers(vertices, edges).groupBy("graph_id").agg((F.max("core") + 1).alias("lower"))


def core_lower_of_rows(rows: DataFrame) -> DataFrame:
    """core_lower of packed rows."""
    return graph.top_cores_of_rows(rows).select("graph_id", (F.col("core") + 1).alias("lower"))


def fixpoint(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, td) by the fixpoint over states, choices and children; fixpoint.solve() gives its forests too."""
    return states.solve(vertices, edges).treedepth()
