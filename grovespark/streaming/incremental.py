"""Graphs that arrive over time: each micro-batch is solved as a batch of its own and appended."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovespark.operators import kernels
from grovespark.operators.graph import canonical_edges, vertices_of


def solve_stream(graphs: DataFrame, out: str, checkpoint: str, seconds: float | None = None):
    """Start a query over a stream of whole graphs (graph_id, edges array<struct<u, v>>) that appends results to out.

    A column vertices (array of ids), if there is one, adds vertices without edges; a graph without any
    vertex has no row. A batch that is run again overwrites its own folder, so each graph is reported once.
    """
    own = "vertices" in graphs.columns

    def solve(batch: DataFrame, epoch: int) -> None:
        pairs = batch.select("graph_id", F.explode("edges").alias("e")).select("graph_id", "e.u", "e.v")
        edges = canonical_edges(pairs)
        vertices = vertices_of(edges)
        if own:
            vertices = vertices.union(batch.select("graph_id", F.explode("vertices").alias("v"))).distinct()
        kernels.results(kernels.solve(vertices, edges, seconds)).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return graphs.writeStream.foreachBatch(solve).option("checkpointLocation", checkpoint).start()
