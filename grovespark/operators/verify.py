"""Verification of elimination forests. tree(graph_id, v, parent), parent 0 a root; declared(graph_id, depth)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovespark.functions.loops import written

#: Joins of one plan when edges climb.
JOINS = 8


def ancestors(tree: DataFrame) -> DataFrame:
    """(graph_id, v, ancestor, up, top): every vertex with itself and all above it; top if that is a root.

    Known ways up are doubled in each round, so a forest of depth d takes about log2(d) rounds. Ways on
    a cycle end before they are as long as their graph has vertices, and reach no root.
    """
    size = tree.groupBy("graph_id").agg(F.count("*").alias("n"))
    rows = written(tree.join(size, "graph_id").select("graph_id", "v", "parent", "n"))
    pairs = rows.select("graph_id", "v", F.col("v").alias("ancestor"), F.lit(0).cast("long").alias("up"), "n").distinct()
    jump = rows.where("parent != 0").select("graph_id", "v", F.col("parent").alias("far")).distinct()
    most = rows.agg(F.max("n")).first()[0] or 0
    step = 1
    while step < most and not jump.isEmpty():
        above = pairs.select("graph_id", F.col("v").alias("far"), "ancestor", "up", "n")
        more = jump.join(above, ["graph_id", "far"]).select("graph_id", "v", "ancestor", (F.col("up") + step).alias("up"), "n").where("up < n")
        pairs = written(pairs.union(more).distinct())
        jump = written(jump.join(jump.select("graph_id", F.col("v").alias("far"), F.col("far").alias("next")), ["graph_id", "far"]).select("graph_id", "v", F.col("next").alias("far")).distinct())
        step *= 2
    roots = rows.where("parent = 0").select("graph_id", F.col("v").alias("ancestor"), F.lit(True).alias("top")).distinct()
    return written(pairs.join(roots, ["graph_id", "ancestor"], "left").select("graph_id", "v", "ancestor", "up", F.coalesce("top", F.lit(False)).alias("top")))


@dataclass
class Climb:
    """What a forest's vertices reach: placed(graph_id, v, depth), depth 1 for roots and null where no root is reached, and for each k the vertex 2**k above, jumps[k](graph_id, v, far)."""

    placed: DataFrame
    jumps: list[DataFrame]


def climb(tree: DataFrame) -> Climb:
    """Depths of a forest by pointer doubling: round k knows the vertex 2**k above each, and the depth of those that have none.

    Each table has a row a vertex at most, so a forest of depth d costs its vertices times log2(d).
    Vertices on a cycle stay until 2**k passes the size of their graph. Graphs where a vertex has two
    parents are not climbed.
    """
    rows = tree.groupBy("graph_id", "v").agg(F.min("parent").alias("parent"), F.count("*").alias("k"))
    broken = rows.where("k > 1").select("graph_id").distinct()
    rows = written(rows.join(broken, "graph_id", "left_anti").select("graph_id", "v", "parent"))
    most = rows.groupBy("graph_id").count().agg(F.max("count")).first()[0] or 0
    done = rows.where("parent = 0").select("graph_id", "v", F.lit(1).cast("long").alias("depth"))
    jump = rows.where("parent != 0").select("graph_id", "v", F.col("parent").alias("far"))
    jumps, step = [], 1
    while True:
        # far is at depth 2**k at most where it is known by now; all others are 2**k higher than their far
        at = done.select("graph_id", F.col("v").alias("far"), "depth")
        met = jump.join(at, ["graph_id", "far"], "left")
        next_ = jump.select("graph_id", F.col("v").alias("far"), F.col("far").alias("next"))
        now = written(met.join(next_, ["graph_id", "far"], "left").select("graph_id", "v", "far", (F.col("depth") + step).alias("depth"), "next"))
        jumps.append(now.select("graph_id", "v", "far"))
        done = done.unionAll(now.where("depth IS NOT NULL").select("graph_id", "v", "depth"))
        jump = now.where("depth IS NULL AND next IS NOT NULL").select("graph_id", "v", F.col("next").alias("far"))
        step *= 2
        if step > most or jump.isEmpty():
            break
    placed = tree.select("graph_id", "v").distinct().join(done, ["graph_id", "v"], "left")
    return Climb(written(placed), jumps)


def is_tree(tree: DataFrame, up: Climb | None = None) -> DataFrame:
    """(graph_id, is_tree): every vertex reaches a root, no vertex has two parents; several roots are fine. up: the climb, if known."""
    reached = (climb(tree) if up is None else up).placed.groupBy("graph_id").agg(F.count("depth").alias("k"))
    return tree.groupBy("graph_id").agg(F.count("*").alias("n")).join(reached, "graph_id").select("graph_id", (F.col("n") == F.col("k")).alias("is_tree"))


def tree_depth(tree: DataFrame, up: Climb | None = None) -> DataFrame:
    """(graph_id, depth) in vertices, of those that reach a root; no row for graphs without any."""
    return (climb(tree) if up is None else up).placed.groupBy("graph_id").agg(F.max("depth").cast("int").alias("depth")).where("depth IS NOT NULL")


def uncovered_edges(edges: DataFrame, tree: DataFrame, up: Climb | None = None) -> DataFrame:
    """Edges whose ends are not ancestor and descendant.

    The deeper end of each edge climbs by the difference of depths, one join for each power of two in it,
    and must arrive at the other.
    """
    up = climb(tree) if up is None else up
    at = lambda c: up.placed.select("graph_id", F.col("v").alias(c), F.col("depth").alias(f"d{c}"))
    both = edges.select("graph_id", "u", "v").join(at("u"), ["graph_id", "u"], "left").join(at("v"), ["graph_id", "v"], "left")
    lower = F.col("du") > F.col("dv")
    deeper, other = (F.when(lower, F.col(a)).otherwise(F.col(b)) for a, b in (("u", "v"), ("v", "u")))
    now = both.select("graph_id", "u", "v", deeper.alias("at"), other.alias("to"), F.abs(F.col("du") - F.col("dv")).alias("left"))
    for k, jump in enumerate(up.jumps):
        jump = jump.select("graph_id", F.col("v").alias("from"), F.col("far"))
        on = (F.col("e.graph_id") == F.col("j.graph_id")) & (F.when((F.col("e.left").bitwiseAND(1 << k)) != 0, F.col("e.at")) == F.col("j.from"))
        now = now.alias("e").join(jump.alias("j"), on, "left").select("e.graph_id", "e.u", "e.v", F.coalesce("j.far", "e.at").alias("at"), "e.to", "e.left")
        if k % JOINS == JOINS - 1:
            now = written(now)
    return now.where(~F.coalesce(F.col("at") == F.col("to"), F.lit(False)) | F.col("left").isNull()).select("graph_id", "u", "v")


def verify(vertices: DataFrame, edges: DataFrame, tree: DataFrame, declared: DataFrame) -> DataFrame:
    """(graph_id, ok, reason, declared, actual): vertex sets equal, a forest, all edges covered, depth as declared. Optimality is not checked."""
    key, up = ["graph_id"], climb(tree)
    both = vertices.select("graph_id", "v", F.lit(1).alias("a"), F.lit(0).alias("b")).unionAll(tree.select("graph_id", "v", F.lit(0), F.lit(1)))
    extra = both.groupBy("graph_id", "v").agg(F.max("a").alias("a"), F.max("b").alias("b")).where("a != b").select("graph_id").distinct().withColumn("_v", F.lit(True))
    bad = uncovered_edges(edges, tree, up).select("graph_id").distinct().withColumn("_e", F.lit(True))
    all_ = vertices.select("graph_id").distinct().join(extra, key, "left").join(is_tree(tree, up), key, "left").join(bad, key, "left").join(tree_depth(tree, up), key, "left").join(declared.select("graph_id", F.col("depth").alias("declared")), key, "left")
    reason = (
        F.when(F.col("_v"), "vertices").when(~F.coalesce("is_tree", F.lit(False)), "tree").when(F.col("_e"), "edge")
        .when(~F.col("declared").eqNullSafe(F.col("depth")), "depth")
    )
    return all_.select("graph_id", reason.isNull().alias("ok"), reason.alias("reason"), "declared", F.col("depth").alias("actual"))


def digest_of_rows(rows: DataFrame) -> DataFrame:
    """(graph_id, depth, uncovered, is_tree) of rows (graph_id, vs, es, up) as fixpoint.forests_of_rows gives them, by the climb above within the rows of a batch; no row for graphs that reach no root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            up, es = batch.column("up"), batch.column("es")
            n, m = (np.diff(x.offsets.to_numpy()).astype(np.int64) for x in (up, es))
            start, total = np.concatenate(([0], np.cumsum(n)[:-1])), int(n.sum())
            graph, of = np.repeat(np.arange(len(n)), n), np.repeat(np.arange(len(m)), m)
            parent = up.flatten().to_numpy().astype(np.int64)
            # place total is above all roots; what has reached it stays there
            far = np.append(np.where(parent == 0, total, start[graph] + parent - 1), total)
            depth, jumps, step = np.append(np.ones(total, np.int64), 0), [], 1
            while True:
                jumps.append(far)
                if step > n.max() or (far == total).all():
                    break
                depth = depth + depth[far]
                far, step = far[far], step * 2
            placed = far[:total] == total
            ends = es.flatten().to_numpy()
            u, v = start[of] + (ends >> 32), start[of] + (ends & 0xFFFFFFFF)
            low, high = np.where(depth[u] > depth[v], u, v), np.where(depth[u] > depth[v], v, u)
            left = depth[low] - depth[high]
            for k, jump in enumerate(jumps):
                low = np.where(left >> k & 1 == 1, jump[low], low)
            bad = (low != high) | ~placed[u] | ~placed[v]
            deepest = np.zeros(len(n), np.int64)
            np.maximum.at(deepest, graph[placed], depth[:total][placed])
            reached, uncovered = np.bincount(graph[placed], minlength=len(n)), np.bincount(of[bad], minlength=len(n))
            columns = [batch.column("graph_id"), pa.array(deepest, pa.int32()), pa.array(uncovered, pa.int64()), pa.array(reached == n)]
            yield pa.RecordBatch.from_arrays(columns, names=["graph_id", "depth", "uncovered", "is_tree"]).filter(pa.array(deepest > 0))

    return rows.mapInArrow(run, "graph_id string, depth int, uncovered long, is_tree boolean")
