"""Operators that run a kernel on each graph whole: a graph is packed into one row, rows spread over tasks.

The row holds a graph's vertices and edges; batches have few rows, so memory follows the largest
graph, not the batch of graphs.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from itertools import batched

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovespark.functions import bitgraph as bg
from grovespark.operators import graph


#: Components whose rooted bounds a task remembers.
KNOWN = 100_000

#: Rows of a kernel that are sent on at once; a graph may have any number.
ROWS = 10_000


def packed(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, vs, es): one row per graph."""
    vs = vertices.groupBy("graph_id").agg(F.array_sort(F.collect_set("v")).alias("vs"))
    es = edges.groupBy("graph_id").agg(F.array_sort(F.collect_set(F.struct("u", "v"))).alias("es"))
    return vs.join(es, "graph_id", "left")


def per_graph(vertices: DataFrame, edges: DataFrame, kernel: Callable[[list[int], list[int]], Iterator[tuple]], schema: str) -> DataFrame:
    """Rows (graph_id, ...) of kernel(neighbours, ids) for each graph; ids[i] is the vertex of bit i."""
    # a fixed number of parts: small rows may be long work, which would meet in one task otherwise
    parts = int(vertices.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = packed(vertices, edges).repartition(parts, "graph_id")
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(100_000)
        for batch in batches:
            for row in batch.to_pylist():
                ids = row["vs"]
                at = {v: i for i, v in enumerate(ids)}
                nb = bg.build(len(ids), ((at[e["u"]], at[e["v"]]) for e in row["es"] or ()))
                for out in batched(kernel(nb, ids), ROWS):
                    columns = ([row["graph_id"]] * len(out), *zip(*out))
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return rows.mapInArrow(run, fields)


def _parts(nb: list[int]) -> list[int]:
    return bg.components(nb, (1 << len(nb)) - 1)


def _names(mask: int, ids: list[int]) -> list[int]:
    return [ids[i] for i in bg.bits(mask)]


def dfs_tree(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, v, parent, depth) of a depth-first search of each component from its least vertex, larger neighbours first; parent 0 is a root."""

    def kernel(nb, ids):
        for part in _parts(nb):
            parent = bg.dfs_parents(nb, part, (part & -part).bit_length() - 1)
            depth: dict[int, int] = {}
            for v, up in parent.items():
                depth[v] = 1 if up < 0 else depth[up] + 1
                yield ids[v], 0 if up < 0 else ids[up], depth[v]

    return per_graph(vertices, edges, kernel, "graph_id string, v int, parent int, depth int")


def separators(vertices: DataFrame, edges: DataFrame, mode: str = "strict") -> DataFrame:
    """(graph_id, sep, largest_n, largest_m, fully_minimal): all minimal separators of each component.

    The largest component beside a separator is by vertices, then edges. mode 'leaf_tolerant' excuses
    single leaves from seeing all of a separator.
    """
    if mode not in ("strict", "leaf_tolerant"):
        raise ValueError(mode)

    def kernel(nb, ids):
        for part in _parts(nb):
            for sep in bg.minimal_separators(nb, part):
                rest = bg.components(nb, part & ~sep)
                size = lambda c: (c.bit_count(), sum((nb[v] & c).bit_count() for v in bg.bits(c)) // 2)
                n, m = max(map(size, rest))
                yield _names(sep, ids), n, m, bg.is_fully_minimal(nb, part, sep, mode == "leaf_tolerant")

    return per_graph(vertices, edges, kernel, "graph_id string, sep array<int>, largest_n int, largest_m int, fully_minimal boolean")


def fully_minimal_separators(vertices: DataFrame, edges: DataFrame, mode: str = "strict") -> DataFrame:
    return separators(vertices, edges, mode).where("fully_minimal").drop("fully_minimal")


def separator_batches(vertices: DataFrame, edges: DataFrame, size: int = 10_000) -> DataFrame:
    """(graph_id, batch, sep): minimal separators as they are found, numbered in batches of size; the last of a graph may be smaller."""
    if size < 1:
        raise ValueError(size)

    def kernel(nb, ids):
        found = (sep for part in _parts(nb) for sep in bg.minimal_separators(nb, part))
        return ((k // size, _names(sep, ids)) for k, sep in enumerate(found))

    return per_graph(vertices, edges, kernel, "graph_id string, batch int, sep array<int>")


def articulation_kernel(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, v) whose removal splits a component."""
    return per_graph(vertices, edges, lambda nb, ids: ((v,) for v in _names(bg.articulation(nb, (1 << len(nb)) - 1), ids)), "graph_id string, v int")


def tree_treedepth(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, td, root) of trees by ranking; for a forest that of its deepest tree. Raises on a cycle."""

    def kernel(nb, ids):
        found = []
        for part in _parts(nb):
            if sum((nb[v] & part).bit_count() for v in bg.bits(part)) // 2 != part.bit_count() - 1:
                raise ValueError("a component is no tree")
            found.append(bg.tree_ranks(nb, part))
        td, root = max(found, key=lambda x: (x[0], -x[1]))
        yield td, ids[root]

    return per_graph(vertices, edges, kernel, "graph_id string, td int, root int")


def solve(vertices: DataFrame, edges: DataFrame, seconds: float | None = None, window: tuple[int, int] | None = None) -> DataFrame:
    """(graph_id, n, m, lb, ub, td, status, v[], parent[]): exact treedepth and an elimination forest of each graph.

    status is 'exact', or 'bounded' where the seconds for a graph ran out; td is null then and the
    forest has depth ub. parent 0 is a root, so forests are for vertices from 1 on; bounds for any.
    With a window (low, high) the search of a component ends as soon as its ub is at most low or its lb
    at least high; status is 'decided' where that came before the exact value.
    """

    def kernel(nb, ids):
        solver = bg.Solver(nb, seconds, window)
        low = up = 0
        parent: dict[int, int] = {}
        for part in _parts(nb):
            a, b = solver.solve(part)
            low, up = max(low, a), max(up, b)
            parent |= solver.tree(part)
        m = sum(x.bit_count() for x in nb) // 2
        vs = sorted(parent)
        status = "exact" if low == up else "decided" if window and (low >= window[1] or up <= window[0]) else "bounded"
        yield len(ids), m, low, up, low if low == up else None, status, [ids[v] for v in vs], [0 if parent[v] < 0 else ids[parent[v]] for v in vs]

    return per_graph(vertices, edges, kernel, "graph_id string, n int, m int, lb int, ub int, td int, status string, v array<int>, parent array<int>")


def results(solved: DataFrame) -> DataFrame:
    return solved.drop("v", "parent")


def trees(solved: DataFrame) -> DataFrame:
    """(graph_id, v, parent) of solved graphs."""
    return solved.select("graph_id", F.explode(F.arrays_zip("v", "parent")).alias("x")).select("graph_id", "x.v", "x.parent")


def brute_force(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, td) by definition; exponential, for graphs of a dozen vertices."""
    return per_graph(vertices, edges, lambda nb, ids: [(bg.brute_force(nb, (1 << len(nb)) - 1),)], "graph_id string, td int")


def automorphisms(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, image): every automorphism as the images of the vertices in order. For small graphs."""
    return per_graph(vertices, edges, lambda nb, ids: (([ids[i] for i in p],) for p in bg.automorphisms(nb, len(nb))), "graph_id string, image array<int>")


def rooted_bounds(vertices: DataFrame, edges: DataFrame, seconds: float | None = None) -> DataFrame:
    """(graph_id, v, lower, upper): least depth of an elimination tree of v's component that has v as its root.

    The components without v are solved one after the other; bounds are equal unless the seconds for a
    graph ran out. Their least value over a component is its treedepth. Without a limit of seconds,
    components that are equal up to the names of their vertices in order are solved once in a batch.
    """

    def bounds(solver: bg.Solver, nb: list[int], part: int) -> Iterator[tuple[int, int]]:
        for v in bg.bits(part):
            found = [solver.solve(c) for c in bg.components(nb, part & ~(1 << v))] or [(0, 0)]
            yield 1 + max(a for a, _ in found), 1 + max(b for _, b in found)

    def kernel(nb, ids):
        solver = bg.Solver(nb, seconds)
        return ((ids[v], *x) for part in _parts(nb) for v, x in zip(bg.bits(part), bounds(solver, nb, part)))

    each = lambda v, e: per_graph(v, e, kernel, "graph_id string, v int, lower int, upper int")
    if seconds is not None:
        return each(vertices, edges)
    met: dict[tuple[int, ...], list[tuple[int, int]]] = {}

    def rows(nb, ids):
        if len(met) > KNOWN:
            met.clear()
        vs, lower, upper = [], [], []
        for part in _parts(nb):
            own = bg.bits(part)
            place = {v: k for k, v in enumerate(own)}
            form = tuple(sum(1 << place[w] for w in bg.bits(nb[v])) for v in own)
            if (found := met.get(form)) is None:
                met[form] = found = list(bounds(bg.Solver(list(form)), list(form), (1 << len(form)) - 1))
            vs += [ids[v] for v in own]
            lower += [a for a, _ in found]
            upper += [b for _, b in found]
        return vs, lower, upper

    return graph._whole(vertices, edges, graph._each(rows, ["v", "lower", "upper"]), "graph_id string, v int, lower int, upper int", each, graph.WHOLE)


#: The largest size of a group that a column of it can hold.
MOST = 10**38 - 1


def orbits(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, v, representative, generators, group_size): the least vertex that an automorphism takes to v, how many
    automorphisms generate all, and how many there are (null if over 38 digits)."""

    def kernel(nb, ids):
        made, size = bg.generators(nb, len(nb))
        low = list(range(len(ids)))

        def top(v: int) -> int:
            while low[v] != v:
                v = low[v]
            return v

        for p in made:
            for v, w in enumerate(p):
                a, b = sorted((top(v), top(w)))
                low[b] = a
        for v in range(len(ids)):
            yield ids[v], ids[top(v)], len(made), size if size <= MOST else None

    return per_graph(vertices, edges, kernel, "graph_id string, v int, representative int, generators int, group_size decimal(38,0)")


def automorphism_summary(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, orbits, generators, group_size)."""
    return orbits(vertices, edges).groupBy("graph_id").agg(F.count_distinct("representative").alias("orbits"), F.first("generators").alias("generators"), F.first("group_size").alias("group_size"))
