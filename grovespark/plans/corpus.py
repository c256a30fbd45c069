"""Batch runs over folders of graph files: solve each within a time limit, verify, report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovespark.functions.loops import written
from grovespark.operators import kernels, verify
from grovespark.operators.graph import canonical_edges
from grovespark.sources import files


def solve_folder(spark: SparkSession, paths, seconds: float | None = None, mode: str = "STRICT") -> tuple[DataFrame, DataFrame]:
    """(report, trees) of all .gr files: bounds, treedepth where proved, and whether the tree of depth ub passes verification.

    One task per graph at a time; a graph that runs out of its seconds is 'bounded'. A file without
    vertices has no row.
    """
    vertices, edges = files.read_gr(spark, paths, mode)
    solved = written(kernels.solve(vertices, edges, seconds))
    trees = kernels.trees(solved)
    checked = verify.verify(vertices, edges, trees, solved.select("graph_id", F.col("ub").alias("depth"))).select("graph_id", "ok", "reason")
    return kernels.results(solved).join(checked, "graph_id"), trees


def disagreements(report: DataFrame, golden: DataFrame) -> DataFrame:
    """Graphs whose bounds exclude the value of golden(graph_id, td)."""
    both = report.drop("td").join(golden.select("graph_id", "td"), "graph_id")
    return both.where("td < lb OR td > ub")


def made_up_graphs(spark: SparkSession, graphs: int = 24, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of connected graphs 'made_<k>' of 24 + k vertices: each hangs on two or three of the eight before it."""
    ids = spark.range(graphs).select(F.concat(F.lit("made_"), F.col("id").cast("string")).alias("graph_id"), (24 + F.col("id")).cast("int").alias("n"))
    vertices = ids.select("graph_id", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("v"))
    ends = vertices.where("v > 1").select("graph_id", "v", F.explode(F.sequence(F.lit(1), F.expr(f"cast(2 + pmod(xxhash64(graph_id, v, {seed}), 2) AS int)"))).alias("k"))
    up = F.expr(f"v - 1 - cast(pmod(xxhash64(graph_id, v, k, {seed}), least(v - 1, 8)) AS int)")
    return vertices, canonical_edges(ends.select("graph_id", up.alias("u"), "v"))
