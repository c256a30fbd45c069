"""Centralities of all graphs of a batch: degree, betweenness over ordered pairs, and eight power steps of two kinds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovespark.functions.bitgraph import path_shares
from grovespark.functions.loops import written
from grovespark.operators.graph import adjacency, degrees
from grovespark.operators.kernels import packed

STEPS = 8
#: Vertices to start shortest paths from that one row of work has.
SOURCES = 256
DAMPING = 0.85
#: Edges of a graph that goes through a power iteration as one row.
PACKED_EDGES = 500_000
#: Steps between two scalings: a step multiplies by a graph's size at most, so numbers stay finite.
SCALE_STEPS = 8


def degree(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    return degrees(vertices, edges).select("graph_id", "v", F.col("degree").cast("double").alias("score"))


def shortest_paths(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, s, t, d, paths): distance and number of shortest paths of all connected ordered pairs."""
    adj = written(adjacency(edges))
    front = written(vertices.select("graph_id", F.col("v").alias("s"), F.col("v").alias("t"), F.lit(0).alias("d"), F.lit(1.0).alias("paths")))
    reached = front
    while not front.isEmpty():
        step = front.withColumnRenamed("t", "src").join(adj, ["graph_id", "src"]).groupBy("graph_id", "s", F.col("dst").alias("t")).agg((F.min("d") + 1).alias("d"), F.sum("paths").alias("paths"))
        front = written(step.join(reached, ["graph_id", "s", "t"], "left_anti").select("graph_id", "s", "t", "d", "paths"))
        reached = reached.union(front)
    return reached


def betweenness(vertices: DataFrame, edges: DataFrame, sources: int = SOURCES) -> DataFrame:
    """Shares of shortest paths through each vertex, every unordered pair counted in both orders, not normalised.

    A row holds a graph and so many of its vertices to start from, so a large graph is the work of many
    tasks; their shares are summed by partial aggregates.
    """
    rows = packed(vertices, edges).withColumn("turn", F.explode(F.sequence(F.lit(0), F.expr(f"(size(vs) - 1) div {sources}").cast("int")))).repartition("graph_id", "turn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                at = {v: i for i, v in enumerate(row["vs"])}
                beside: list[list[int]] = [[] for _ in at]
                for e in row["es"] or ():
                    beside[at[e["u"]]].append(at[e["v"]])
                    beside[at[e["v"]]].append(at[e["u"]])
                found = path_shares(beside, range(row["turn"] * sources, min(len(at), (row["turn"] + 1) * sources)))
                yield pa.RecordBatch.from_arrays([pa.array([row["graph_id"]] * len(at), pa.string()), pa.array(row["vs"], pa.int32()), pa.array(found, pa.float64())], names=["graph_id", "v", "score"])

    return rows.mapInArrow(run, "graph_id string, v int, score double").groupBy("graph_id", "v").agg(F.sum("score").alias("score"))


def _power(vertices: DataFrame, edges: DataFrame, steps: int, damping: float | None, most: int = PACKED_EDGES) -> DataFrame:
    """Graphs of at most most edges go through one pass, a row of work each, larger ones through a join and two aggregates a step."""
    large = written(edges.groupBy("graph_id").agg(F.count("*").alias("m")).where(F.col("m") > most).select("graph_id"))
    part = lambda df, how: df.join(F.broadcast(large) if large.count() <= 10_000 else large, "graph_id", how)
    rows = packed(part(vertices, "left_anti"), part(edges, "left_anti"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, vs, xs = [], [], []
            for graph_id, ids, es in zip(batch.column("graph_id").to_pylist(), batch.column("vs"), batch.column("es")):
                ids = ids.values.to_numpy()
                u, v = (np.searchsorted(ids, es.values.field(c).to_numpy()) for c in "uv") if es.is_valid else (np.empty(0, np.int64),) * 2
                x = np.full(len(ids), 1 / np.sqrt(len(ids)))
                for k in range(1, steps + 1):
                    new = np.bincount(u, x[v], len(ids)) + np.bincount(v, x[u], len(ids))
                    x = new if damping is None else damping * new + (1 - damping) * x.sum()
                    if k % SCALE_STEPS == 0 or k == steps:
                        norm = np.sqrt((x * x).sum())
                        x = x / norm if norm > 0 else np.zeros_like(x)
                names += [graph_id] * len(ids)
                vs.append(ids)
                xs.append(x)
            cols = [pa.array(names, pa.string()), pa.array(np.concatenate([*vs, np.empty(0, np.int32)]).astype(np.int32)), pa.array(np.concatenate([*xs, np.empty(0)]))]
            yield pa.RecordBatch.from_arrays(cols, names=["graph_id", "v", "score"])

    small = rows.mapInArrow(run, "graph_id string, v int, score double")
    return small if large.isEmpty() else small.unionByName(_power_rounds(part(vertices, "left_semi"), part(edges, "left_semi"), steps, damping))


def _power_rounds(vertices: DataFrame, edges: DataFrame, steps: int, damping: float | None) -> DataFrame:
    adj = written(adjacency(edges))
    count = vertices.groupBy("graph_id").agg(F.count("*").alias("n"))
    x = vertices.join(count, "graph_id").select("graph_id", "v", F.sqrt(1 / F.col("n")).alias("x"))
    for k in range(1, steps + 1):
        heard = adj.join(x.withColumnRenamed("v", "src"), ["graph_id", "src"]).groupBy("graph_id", F.col("dst").alias("v")).agg(F.sum("x").alias("h"))
        new = x.select("graph_id", "v").join(heard, ["graph_id", "v"], "left").select("graph_id", "v", F.coalesce("h", F.lit(0.0)).alias("x"))
        if damping is not None:
            total = x.groupBy("graph_id").agg(F.sum("x").alias("total"))
            new = new.join(total, "graph_id").select("graph_id", "v", (damping * F.col("x") + (1 - damping) * F.col("total")).alias("x"))
        x = written(new)
        if k % SCALE_STEPS == 0 or k == steps:
            norm = x.groupBy("graph_id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
            x = x.join(norm, "graph_id").select("graph_id", "v", F.when(F.col("norm") > 0, F.col("x") / F.col("norm")).otherwise(0.0).alias("x"))
            x = x if k == steps else written(x)
    return x.select("graph_id", "v", F.col("x").alias("score"))


def eigenvector(vertices: DataFrame, edges: DataFrame, steps: int = STEPS) -> DataFrame:
    """Power steps from equal weights, brought to length 1 (steps are linear, so scaling every step gives the same)."""
    return _power(vertices, edges, steps, None)


def pagerank_like(vertices: DataFrame, edges: DataFrame, steps: int = STEPS, damping: float = DAMPING) -> DataFrame:
    """Each step damping * (sum over neighbours) + (1 - damping) * (sum over all), brought to length 1 (once in SCALE_STEPS steps: they are linear); no division by degrees."""
    return _power(vertices, edges, steps, damping)
