"""Minimal separators of graphs of any number of them: the frontier of the search is a table, dealt over all tasks.

A set is a bitmap over the places of its graph's vertices in order. A round joins the frontier, in
chunks of CHUNK sets, with a copy of their graph for each chunk; every member of a set, with its
neighbours, is taken off the graph together with the set, and the neighbourhoods of what is left are
the next sets (after Berry, Bordat and Cogis, 1999). What is done is kept out by an anti-join, so a
set is expanded once, whichever task has met it. Rounds run for all graphs together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovespark.functions import bitgraph as bg
from grovespark.functions.loops import written
from grovespark.operators.kernels import packed

#: Sets that one row of work has; a graph travels once for each.
CHUNK = 500
SETS = "graph_id string, sep binary"


def _bytes(mask: int, n: int) -> bytes:
    return mask.to_bytes((n + 7) // 8, "little")


def _mask(data: bytes) -> int:
    return int.from_bytes(data, "little")


def _met(nb: list[int], inside: int, removed: int) -> Iterator[int]:
    """The neighbourhoods of the components of a set without some of its vertices."""
    for part in bg.components(nb, inside & ~removed):
        if sep := bg.around(nb, part) & inside:
            yield sep


def _in_chunks(graphs: DataFrame, sets: DataFrame, kernel: Callable[[list[int], list[int], list[int]], Iterator[tuple]], schema: str) -> DataFrame:
    """Rows (graph_id, ...) of kernel(neighbours, ids, masks) for chunks of the sets (graph_id, sep) of each graph."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(schema)
    arrow, parts = to_arrow_schema(fields), int(graphs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = sets.groupBy("graph_id").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    dealt = sets.join(counts, "graph_id").withColumn("chunk", F.expr("cast(pmod(xxhash64(sep), chunks) AS int)"))
    dealt = dealt.groupBy("graph_id", "chunk").agg(F.collect_list("sep").alias("seps"))
    copies = graphs.join(counts, "graph_id").withColumn("chunk", F.explode(F.expr("sequence(0, chunks - 1)"))).drop("chunks")
    # a fixed number of parts: small rows are long work, which would meet in one task otherwise
    work = dealt.join(copies, ["graph_id", "chunk"]).repartition(parts, "graph_id", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = row["vs"]
                at = {v: i for i, v in enumerate(ids)}
                nb = bg.build(len(ids), ((at[e["u"]], at[e["v"]]) for e in row["es"] or ()))
                out = [(row["graph_id"], *x) for x in kernel(nb, ids, [_mask(s) for s in row["seps"]])]
                columns = list(zip(*out)) or [()] * len(arrow)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return work.mapInArrow(run, fields)


def _seeds(graphs: DataFrame) -> DataFrame:
    """The neighbourhoods of what each vertex, with its neighbours, leaves of its component; every vertex is a set of its own to deal."""
    ones = graphs.select("graph_id", F.size("vs").alias("n"), F.explode(F.expr("sequence(0, size(vs) - 1)")).alias("i"))
    byte = F.expr("unhex(lpad(hex(shiftleft(1, i % 8)), 2, '0'))")
    low, high = (F.expr(f"unhex(repeat('00', {k}))") for k in ("i div 8", "(n + 7) div 8 - 1 - i div 8"))
    ones = ones.select("graph_id", F.concat(low, byte, high).alias("sep"))

    def kernel(nb, ids, masks):
        found = set()
        for mask in masks:
            v = mask.bit_length() - 1
            own = bg.flood(nb, mask, (1 << len(nb)) - 1)
            found.update(_met(nb, own, mask | nb[v]))
        return ((_bytes(s, len(nb)),) for s in found)

    return _in_chunks(graphs, ones, kernel, SETS).distinct()


def _expanded(graphs: DataFrame, frontier: DataFrame) -> DataFrame:
    def kernel(nb, ids, masks):
        found = set()
        for mask in masks:
            own = bg.flood(nb, mask & -mask, (1 << len(nb)) - 1)
            for v in bg.bits(mask):
                found.update(_met(nb, own, mask | nb[v]))
        return ((_bytes(s, len(nb)),) for s in found)

    return _in_chunks(graphs, frontier, kernel, SETS).distinct()


@dataclass
class Pull:
    """A search that can go on: graphs, the sets found so far and those of them that are still to expand, all written tables."""

    graphs: DataFrame
    done: DataFrame
    frontier: DataFrame

    @classmethod
    def start(cls, vertices: DataFrame, edges: DataFrame) -> Pull:
        """Before the first call: the seeds are found and none is expanded."""
        graphs = written(packed(vertices, edges))
        seeds = written(_seeds(graphs))
        return cls(graphs, seeds, seeds)

    def has_next(self) -> bool:
        return not self.frontier.isEmpty()

    def next(self, k: int | None = None) -> tuple[DataFrame, Pull]:
        """(the sets that are new, the search after them): at least k in all, unless fewer are left; None: the sets of one round.

        At most k sets of the frontier are expanded at a time, least sets first, so the work follows k.
        """
        if k is not None and k < 1:
            raise ValueError(k)
        now, batch, found = self, None, 0
        while batch is None or (found < (k or 1) and now.has_next()):
            front, rest = now.frontier, None
            if k is not None:
                front = written(front.orderBy(F.length("sep"), "sep", "graph_id").limit(k))
                rest = now.frontier.join(front, ["graph_id", "sep"], "left_anti")
            new = written(_expanded(now.graphs, front).join(now.done, ["graph_id", "sep"], "left_anti"))
            left = new if rest is None else written(rest.unionAll(new))
            batch = new if batch is None else batch.unionAll(new)
            now, found = Pull(now.graphs, now.done.unionAll(new), left), found + (new.count() if k is not None else 1)
        return batch, now

    def all(self) -> DataFrame:
        """The sets of the search when it has ended."""
        now = self
        while now.has_next():
            now = now.next()[1]
        return now.done


def named(graphs: DataFrame, sets: DataFrame) -> DataFrame:
    """(graph_id, sep) with the vertices of each set as an ascending array."""
    kernel = lambda nb, ids, masks: (([ids[i] for i in bg.bits(m)],) for m in masks)
    return _in_chunks(graphs, sets, kernel, "graph_id string, sep array<int>")


def described(graphs: DataFrame, sets: DataFrame, mode: str = "strict") -> DataFrame:
    """(graph_id, sep, largest_n, largest_m, fully_minimal) of sets: vertices and edges of the largest component beside each, and whether all components see all of it.

    mode 'leaf_tolerant' excuses single leaves.
    """
    if mode not in ("strict", "leaf_tolerant"):
        raise ValueError(mode)

    def kernel(nb, ids, masks):
        size = lambda c: (c.bit_count(), sum((nb[v] & c).bit_count() for v in bg.bits(c)) // 2)
        for mask in masks:
            own = bg.flood(nb, mask & -mask, (1 << len(nb)) - 1)
            n, m = max(map(size, bg.components(nb, own & ~mask)))
            yield [ids[i] for i in bg.bits(mask)], n, m, bg.is_fully_minimal(nb, own, mask, mode == "leaf_tolerant")

    return _in_chunks(graphs, sets, kernel, "graph_id string, sep array<int>, largest_n int, largest_m int, fully_minimal boolean")


def minimal(vertices: DataFrame, edges: DataFrame, mode: str = "strict") -> DataFrame:
    """All minimal separators of each graph, as kernels.separators gives them, found by as many tasks as their number asks for."""
    search = Pull.start(vertices, edges)
    return described(search.graphs, search.all(), mode)


def fully_minimal(vertices: DataFrame, edges: DataFrame, mode: str = "strict") -> DataFrame:
    return minimal(vertices, edges, mode).where("fully_minimal").drop("fully_minimal")
