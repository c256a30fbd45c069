"""Structure of many graphs at once. vertices(graph_id, v); edges(graph_id, u, v) with u < v, distinct, no loops.

A vertex set is a table members(graph_id, v), one set per graph. Fixpoints run for all graphs
together, so the number of rounds is that of the worst graph, not their sum.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grovespark.functions import bitgraph as bg
from grovespark.functions.loops import written

V = ["graph_id", "v"]

#: Vertices and edges of a graph that is one row of work, where its sets of neighbours are bitmaps.
WHOLE = 8192


def packed(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, all): a row a graph, with a number u * 2^32 + v for each edge, and one with u = v for each vertex; of graphs that fit a row."""
    both = edges.select("graph_id", "u", "v").unionAll(vertices.select("graph_id", F.col("v").alias("u"), "v"))
    return both.groupBy("graph_id").agg(F.collect_list(F.shiftleft(F.col("u").cast("long"), 32).bitwiseOR(F.col("v").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))).alias("all"))


def _by_row(rows: DataFrame, kernel: Callable, schema: str, rest: Callable, most: int) -> DataFrame:
    """What kernel(batches) makes of the packed rows of at most most vertices and edges, and rest(vertices, edges) of the larger ones. Nothing is shuffled but these."""
    large = rows.where(F.size("all") > most).select("graph_id", F.explode("all").alias("e"))
    large = written(large.select("graph_id", F.shiftright("e", 32).cast("int").alias("u"), F.expr("cast(shiftright(shiftleft(e, 32), 32) AS int)").alias("v")))
    found = rows.where(F.size("all") <= most).mapInArrow(kernel, schema)
    return found if large.isEmpty() else found.unionAll(rest(large.where("u = v").select(*V), large.where("u != v")))


def _whole(vertices: DataFrame, edges: DataFrame, kernel: Callable, schema: str, rest: Callable, most: int) -> DataFrame:
    """What kernel(batches) makes of the graphs of at most most vertices and edges, each gathered into one packed row, and rest(vertices, edges) of the larger ones.

    So a graph is shuffled once and its results are not joined to its vertices.
    """
    both = edges.select("graph_id", "u", "v").unionAll(vertices.select("graph_id", F.col("v").alias("u"), "v"))
    large = written(both.groupBy("graph_id").agg(F.count("*").alias("n")).where(F.col("n") > most).select("graph_id"))
    some = not large.isEmpty()
    part = lambda df: df.join(large, "graph_id", "left_anti") if some else df
    found = packed(part(vertices), part(edges)).mapInArrow(kernel, schema)
    return found.unionAll(rest(*(x.join(large, "graph_id", "left_semi") for x in (vertices, edges)))) if some else found


def _ends(numbers: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    x = numbers.to_numpy(zero_copy_only=False)
    return (x >> 32).astype(np.int32), x.astype(np.int32)


def _each(make: Callable[[list[int], list[int]], tuple], names: list[str]) -> Callable:
    """A kernel for _whole: columns of 32-bit numbers that make(neighbours, ids) gives for each graph; ids[i] is the vertex of bit i."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            graphs, columns = [], [[] for _ in names]
            for graph_id, all_ in zip(batch.column("graph_id").to_pylist(), batch.column("all")):
                u, v = _ends(all_.values)
                ids = np.unique(u[u == v])
                a, b = (np.minimum(np.searchsorted(ids, x), len(ids) - 1) for x in (u, v))
                inside = (u != v) & (ids[a] == u) & (ids[b] == v)
                ids = ids.tolist()
                found = make(bg.build(len(ids), zip(a[inside].tolist(), b[inside].tolist())), ids)
                graphs += [graph_id] * len(found[0])
                for column, new in zip(columns, found):
                    column += new
            yield pa.RecordBatch.from_arrays([pa.array(graphs, pa.string()), *(pa.array(x, pa.int32()) for x in columns)], names=["graph_id", *names])

    return run


def canonical_edges(pairs: DataFrame, a: str = "u", b: str = "v") -> DataFrame:
    """Edges of any pairs: loops dropped, ends ordered, repeats merged."""
    return pairs.where(F.col(a) != F.col(b)).select("graph_id", F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct()


def empty(spark) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame([], "graph_id string, v int"), spark.createDataFrame([], "graph_id string, u int, v int")


def vertices_of(edges: DataFrame) -> DataFrame:
    return edges.select("graph_id", F.explode(F.array("u", "v")).alias("v")).distinct()


def adjacency(edges: DataFrame) -> DataFrame:
    """(graph_id, src, dst), both directions."""
    return edges.select("graph_id", F.explode(F.array(F.struct(F.col("u").alias("src"), F.col("v").alias("dst")), F.struct(F.col("v").alias("src"), F.col("u").alias("dst")))).alias("e")).select("graph_id", "e.src", "e.dst")


def neighbourhoods(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, v, nb, deg): neighbours in order."""
    nb = adjacency(edges).groupBy("graph_id", F.col("src").alias("v")).agg(F.array_sort(F.collect_set("dst")).alias("nb"))
    return vertices.join(nb, V, "left").select(*V, F.coalesce("nb", F.array().cast("array<int>")).alias("nb"), F.coalesce(F.size("nb"), F.lit(0)).alias("deg"))


def degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    found = adjacency(edges).groupBy("graph_id", F.col("src").alias("v")).agg(F.count("*").alias("degree"))
    return vertices.join(found, V, "left").select(*V, F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def vertex_set(members: DataFrame) -> DataFrame:
    """(graph_id, vset): each graph's set as an ascending array, a key to join and group by."""
    return members.groupBy("graph_id").agg(F.array_sort(F.collect_set("v")).alias("vset"))


def induced(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges with both ends among members."""
    m = members.select("graph_id", "v").distinct()
    return edges.join(m.withColumnRenamed("v", "u"), ["graph_id", "u"], "left_semi").join(m, V, "left_semi").select("graph_id", "u", "v")


def shapes(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, n, m, min_degree, max_degree, shape) of connected graphs; shape 'other' if none has a name."""
    d = degrees(vertices, edges).groupBy("graph_id").agg(F.count("*").alias("n"), (F.sum("degree") / 2).cast("long").alias("m"), F.min("degree").alias("min_degree"), F.max("degree").alias("max_degree"))
    n, m, top = F.col("n"), F.col("m"), F.col("max_degree")
    shape = (
        F.when(m == n * (n - 1) / 2, "complete").when((m == n - 1) & (top == n - 1), "star").when((m == n) & (top == 2) & (F.col("min_degree") == 2), "cycle")
        .when((m == n - 1) & (top <= 2), "path").when(m == n - 1, "tree").otherwise("other")
    )
    return d.withColumn("shape", shape)


def validate(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Violations (graph_id, rule, n): loops, unordered ends, repeated rows, ends that are no vertices, more than one component."""
    named = lambda df, rule: df.groupBy("graph_id").agg(F.count("*").alias("n")).select("graph_id", F.lit(rule).alias("rule"), "n")
    ends = edges.select("graph_id", F.explode(F.array("u", "v")).alias("v"))
    parts = components(vertices, canonical_edges(edges)).groupBy("graph_id").agg(F.count_distinct("component").alias("n")).where("n > 1")
    return (
        named(edges.where("u = v"), "loop").union(named(edges.where("u > v"), "order"))
        .union(named(edges.groupBy("graph_id", "u", "v").agg(F.count("*").alias("k")).where("k > 1"), "repeated edge"))
        .union(named(vertices.groupBy(*V).agg(F.count("*").alias("k")).where("k > 1"), "repeated vertex"))
        .union(named(ends.join(vertices, V, "left_anti"), "unknown vertex"))
        .union(parts.select("graph_id", F.lit("connected").alias("rule"), "n"))
    )


#: Edges of a graph that one row of work of components has.
COMPONENT_EDGES = 200_000


def components(vertices: DataFrame, edges: DataFrame, most: int = COMPONENT_EDGES) -> DataFrame:
    """(graph_id, v, component): the least vertex reachable.

    Edges are dealt in parts of about most of a graph, and each part is drawn together by itself to its
    own least vertices. Most graphs are one part and so done. Of the others the parts' results, a row a
    vertex at most each, are the edges of what is left to do in rounds.
    """
    edges = written(edges.select("graph_id", "u", "v"))
    sizes = edges.groupBy("graph_id").agg(F.ceil(F.count("*") / most).cast("int").alias("parts"))
    dealt = edges.join(sizes, "graph_id").withColumn("part", F.when(F.col("parts") == 1, 0).otherwise(F.expr("cast(pmod(xxhash64(u div 1024, v div 65536), parts) AS int)")))
    rows = dealt.groupBy("graph_id", "part").agg(F.first("parts").alias("parts"), F.collect_list(F.struct("u", "v")).alias("all"))
    drawn = written(rows.mapInArrow(_drawn, "graph_id string, parts int, v int, low int"))
    label = drawn.where("parts = 1").select(*V, F.col("low").alias("component"))
    rest = written(drawn.where("parts > 1 AND v != low").select("graph_id", F.col("low").alias("u"), "v"))
    if not rest.isEmpty():
        label = label.unionAll(_in_rounds(vertices_of(rest), rest))
    return written(vertices.select(*V).distinct().join(label, V, "left").select(*V, F.coalesce("component", "v").alias("component")))


def _drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(graph_id, parts, v, low): the least vertex that the edges of a row lead each of its vertices to."""
    for batch in batches:
        graphs, parts, vs, lows = [], [], [], []
        for graph_id, n, all_ in zip(batch.column("graph_id").to_pylist(), batch.column("parts").to_pylist(), batch.column("all")):
            low: dict[int, int] = {}

            def top(v: int) -> int:
                while (up := low[v]) != v:
                    low[v] = v = low[up]
                return v

            for u, v in zip(all_.values.field("u").to_pylist(), all_.values.field("v").to_pylist()):
                low.setdefault(u, u)
                low.setdefault(v, v)
                a, b = top(u), top(v)
                if a != b:
                    low[max(a, b)] = min(a, b)
            graphs += [graph_id] * len(low)
            parts += [n] * len(low)
            vs += low
            lows += [top(v) for v in low]
        yield pa.RecordBatch.from_arrays([pa.array(graphs, pa.string()), *(pa.array(x, pa.int32()) for x in (parts, vs, lows))], names=["graph_id", "parts", "v", "low"])


def _in_rounds(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """components() by rounds: labels travel along edges and then jump to their own label, so there are logarithmically many in practice; a round is two joins and a partial minimum."""
    adj = written(adjacency(edges))
    label = written(vertices.distinct().withColumn("component", F.col("v")))
    while True:
        heard = adj.join(label.select("graph_id", F.col("v").alias("src"), "component"), ["graph_id", "src"]).groupBy("graph_id", F.col("dst").alias("v")).agg(F.min("component").alias("low"))
        near = label.join(heard, V, "left").select(*V, F.col("component").alias("was"), F.least("component", F.coalesce("low", "component")).alias("low"))
        jump = label.select("graph_id", F.col("v").alias("low"), F.col("component").alias("far"))
        now = written(near.join(jump, ["graph_id", "low"]).select(*V, "was", F.least("low", "far").alias("component")))
        label = now.select(*V, "component")
        if now.where("component != was").isEmpty():
            return label


def is_connected(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, connected) of one vertex set per graph."""
    return components(members, induced(edges, members)).groupBy("graph_id").agg((F.count_distinct("component") == 1).alias("connected"))


def without(vertices: DataFrame, edges: DataFrame, removed: DataFrame) -> DataFrame:
    """Components of each graph after the vertices in removed(graph_id, v) are gone."""
    kept = vertices.join(removed, V, "left_anti")
    return components(kept, induced(edges, kept))


def bfs(vertices: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(graph_id, v, depth, parent) from roots(graph_id, v): fewest steps; parent is the least neighbour one step nearer. Unreached vertices have no row."""
    adj = written(adjacency(edges))
    front = written(roots.select(*V).distinct().select(*V, F.lit(0).alias("depth"), F.lit(None).cast("int").alias("parent")))
    reached = front
    while not front.isEmpty():
        ahead = front.select("graph_id", F.col("v").alias("src"), "depth").join(adj, ["graph_id", "src"])
        step = ahead.groupBy("graph_id", F.col("dst").alias("v")).agg((F.min("depth") + 1).alias("depth"), F.min("src").alias("parent"))
        front = written(step.join(reached, V, "left_anti").select(*V, "depth", "parent"))
        reached = reached.union(front)
    return reached


#: Vertices (by number) that one row of work of core_numbers has, and neighbours from which on a vertex is one of its own.
CORE_BLOCK = 20_000
HEAVY = 100_000


def core_numbers(vertices: DataFrame, edges: DataFrame, block: int = CORE_BLOCK, heavy: int = HEAVY) -> DataFrame:
    """(graph_id, v, core): the largest k for which v is in the k-core.

    A core number is the largest h such that h neighbours have h or more; degrees are a first bound, and
    bounds that are lowered so until nothing changes are the core numbers, in any order of the steps
    (Lue et al., 2016). A round lowers all vertices of a block as far as they go while those of other
    blocks stay, by peeling it. So a graph within one block takes one round, others as many as changes
    cross from block to block; finished graphs take part no more. A vertex of very many neighbours is
    lowered by counts of these, never gathered. A graph of at most block vertices and edges is one row,
    which is peeled whole.
    """
    return _whole(vertices, edges, _peeled_whole(), "graph_id string, v int, core int", lambda v, e: _core_rounds(v, e, block, heavy), block)


def core_numbers_of_rows(rows: DataFrame, most: int = CORE_BLOCK) -> DataFrame:
    """core_numbers of packed rows."""
    return _by_row(rows, _peeled_whole(), "graph_id string, v int, core int", lambda v, e: _core_rounds(v, e, most, HEAVY), most)


def top_cores_of_rows(rows: DataFrame, most: int = CORE_BLOCK) -> DataFrame:
    """(graph_id, core): the largest core number of each graph of packed rows."""
    top = lambda df: df.groupBy("graph_id").agg(F.max("core").alias("core"))
    return _by_row(rows, _peeled_whole(what="top"), "graph_id string, core int", lambda v, e: top(_core_rounds(v, e, most, HEAVY)), most)


def _peeled_whole(k: int | None = None, what: str = "all") -> Callable:
    """A kernel for packed rows: core numbers (v, core), or a graph's largest (what 'top'); with k the k-cores, (u, v), where u = v is a vertex, or their components (v, component) (what 'parts'). The graphs of a batch are peeled together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_ = batch.column("all")
            u, v = _ends(all_.flatten())
            of = np.repeat(np.arange(len(all_), dtype=np.int64), np.diff(all_.offsets.to_numpy()))
            a, b = (of << 32 | (x.astype(np.int64) + 2**31) for x in (u, v))
            names = np.unique(a[u == v])
            place = [np.minimum(np.searchsorted(names, x), max(len(names) - 1, 0)) for x in (a, b)]
            inside = (u != v) & (names[place[0]] == a) & (names[place[1]] == b) if len(names) else np.zeros(len(u), bool)
            a, b = place[0][inside], place[1][inside]
            core = _peel(len(names), np.concatenate([a, b]), np.concatenate([b, a]))
            if what == "top":
                first = np.flatnonzero(np.diff(names >> 32, prepend=-1))
                graph, columns = names[first] >> 32, [("core", np.maximum.reduceat(core, first) if len(first) else core)]
            elif k is None:
                graph, columns = names >> 32, [("v", names), ("core", core)]
            elif what == "parts":
                kept, alone = (core[a] >= k) & (core[b] >= k), core >= k
                low = _least(len(names), a[kept], b[kept])[alone]
                graph, columns = names[alone] >> 32, [("v", names[alone]), ("component", names[low])]
            else:
                alone, kept = core >= k, (core[a] >= k) & (core[b] >= k)
                u, v = np.concatenate([names[alone], names[a[kept]]]), np.concatenate([names[alone], names[b[kept]]])
                graph, columns = u >> 32, [("u", u), ("v", v)]
            columns = [(c, x if c == "core" else (x & 0xFFFFFFFF) - 2**31) for c, x in columns]
            yield pa.RecordBatch.from_arrays([batch.column("graph_id").take(pa.array(graph)), *(pa.array(x.astype(np.int32)) for _, x in columns)], names=["graph_id", *(c for c, _ in columns)])

    return run


def _peel(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Core numbers of vertices 0 to n - 1; both directions of each edge. A step costs what lies around the vertices that it takes off."""
    order = np.argsort(src, kind="stable")
    dst, starts = dst[order], np.searchsorted(src[order], np.arange(n + 1))
    around, core, left = np.diff(starts), np.full(n, -1, np.int32), np.arange(n)
    while len(left := left[core[left] < 0]):
        k = around[left].min()
        off = left[around[left] <= k]
        while len(off):
            core[off] = k
            many = starts[off + 1] - starts[off]
            near = dst[np.repeat(starts[off] - np.cumsum(many) + many, many) + np.arange(many.sum())]
            near = near[core[near] < 0]
            np.subtract.at(around, near, 1)
            off = np.unique(near[around[near] <= k])
    return core


def _least(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least vertex that edges lead each of the vertices 0 to n - 1 to. Labels fall along edges, and so do those of the labels; each then jumps to its own label."""
    low = np.arange(n)
    while True:
        new = low.copy()
        near = np.minimum(low[a], low[b])
        for x in (a, b, low[a], low[b]):
            np.minimum.at(new, x, near)
        new = new[new]
        if np.array_equal(new, low):
            return low
        low = new


def _core_rounds(vertices: DataFrame, edges: DataFrame, block: int, heavy: int) -> DataFrame:
    deg = written(degrees(vertices.select(*V).distinct(), edges))
    adj = adjacency(edges).join(deg.select("graph_id", F.col("v").alias("src"), F.col("degree").alias("own")), ["graph_id", "src"])
    adj = written(adj.select("graph_id", F.when(F.col("own") <= heavy, F.floor(F.col("src") / block)).alias("block"), "src", "dst"))
    now = deg.select(*V, F.col("degree").cast("int").alias("core"))
    units = adj.groupBy("graph_id").agg(F.count_distinct(F.coalesce("block", -F.col("src") - 1)).alias("k"))
    crossed = not units.where("k > 1").isEmpty()
    while True:
        heard = adj.join(now.select("graph_id", F.col("v").alias("dst"), "core"), ["graph_id", "dst"])
        rows = heard.where("block IS NOT NULL").groupBy("graph_id", "block").agg(F.collect_list(F.struct("src", "dst", "core")).alias("all"))
        lowered = rows.select("graph_id", "all").mapInArrow(_peeled, "graph_id string, v int, core int")
        counts = heard.where("block IS NULL").groupBy("graph_id", "src", "core").agg(F.count("*").alias("n"))
        more = F.sum("n").over(Window.partitionBy("graph_id", "src").orderBy(F.desc("core")))
        hubs = counts.withColumn("h", F.least(F.col("core"), more)).groupBy("graph_id", F.col("src").alias("v")).agg(F.max("h").cast("int").alias("core"))
        new = lowered.unionAll(hubs).withColumnRenamed("core", "new")
        step = written(now.join(new, V, "left").select(*V, F.least("core", F.coalesce("new", "core")).alias("core"), F.coalesce(F.col("new") < F.col("core"), F.lit(False)).alias("moved")))
        now = step.select(*V, "core")
        if not crossed or step.where("moved").isEmpty():
            return now


def _peeled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The greatest bounds within blocks, whose rows are (vertex, neighbour, bound of that): vertices are taken off by rising k, a neighbour outside once k passes its bound."""
    for batch in batches:
        graphs, vs, cores = [], [], []
        for graph_id, all_ in zip(batch.column("graph_id").to_pylist(), batch.column("all")):
            src, dst, bound = (all_.values.field(c).to_numpy(zero_copy_only=False) for c in ("src", "dst", "core"))
            names, own = np.unique(src, return_inverse=True)
            place = np.searchsorted(names, dst)
            inside = names[np.minimum(place, len(names) - 1)] == dst
            left = np.bincount(own, minlength=len(names))
            order = np.argsort(own[inside], kind="stable")
            beside, starts = place[inside][order].tolist(), np.searchsorted(own[inside][order], np.arange(len(names) + 1)).tolist()
            ends = sorted(zip(bound[~inside].tolist(), own[~inside].tolist()))
            found, at = [-1] * len(names), 0
            # vertices by what is left around them; a count only falls, so stale places are passed over
            buckets: dict[int, list[int]] = {}
            for v, k in enumerate(left.tolist()):
                buckets.setdefault(k, []).append(v)
            around, k, gone = left.tolist(), 0, 0
            while gone < len(names):
                while at < len(ends) and ends[at][0] < k:
                    v = ends[at][1]
                    at += 1
                    if found[v] < 0:
                        around[v] -= 1
                        buckets.setdefault(max(around[v], k - 1), []).append(v)
                # all with fewer than k left have core k - 1
                for low in (k - 1, *([0] if k == 1 else [])):
                    todo = buckets.pop(low, [])
                    while todo:
                        v = todo.pop()
                        if found[v] >= 0 or around[v] >= k:
                            continue
                        found[v] = k - 1
                        gone += 1
                        for w in beside[starts[v] : starts[v + 1]]:
                            if found[w] < 0:
                                around[w] -= 1
                                if around[w] < k:
                                    todo.append(w)
                                else:
                                    buckets.setdefault(around[w], []).append(w)
                k += 1
            graphs += [graph_id] * len(names)
            vs.append(names)
            cores += found
        names = np.concatenate([*vs, np.empty(0, np.int32)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(graphs, pa.string()), pa.array(names), pa.array(cores, pa.int32())], names=["graph_id", "v", "core"])


def k_core(vertices: DataFrame, edges: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) left after vertices of degree below k are taken off until none is; graphs without any such vertex stay whole."""

    def rest(v: DataFrame, e: DataFrame) -> DataFrame:
        kept = written(_core_rounds(v, e, CORE_BLOCK, HEAVY).where(F.col("core") >= k).select(*V))
        return induced(e, kept).unionAll(kept.select("graph_id", F.col("v").alias("u"), "v"))

    left = written(_whole(vertices.select(*V), edges, _peeled_whole(k), "graph_id string, u int, v int", rest, CORE_BLOCK))
    return left.where("u = v").select(*V), left.where("u != v")


def core_components(vertices: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """(graph_id, v, component) of the k-core of each graph, whose row has both done."""
    return _whole(vertices.select(*V), edges, _peeled_whole(k, "parts"), PARTS, _rest_of_parts(k), CORE_BLOCK)


PARTS = "graph_id string, v int, component int"


def _rest_of_parts(k: int) -> Callable:
    return lambda v, e: components(*k_core(v, e, k)).select(*V, "component")


def core_components_of_rows(rows: DataFrame, k: int, most: int = CORE_BLOCK) -> DataFrame:
    """core_components of packed rows."""
    return _by_row(rows, _peeled_whole(k, "parts"), PARTS, _rest_of_parts(k), most)


def articulation_points(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, v) whose removal splits a component: every vertex's removal is a graph of its own in one batch.

    The batch has a copy of a graph per vertex, so this is for many small graphs; a large graph goes
    through the same kernel as separators.
    """
    name = lambda g, v: F.concat_ws("\x00", g, v.cast("string"))
    v, w = vertices.alias("v"), vertices.alias("w")
    same = F.col("v.graph_id") == F.col("w.graph_id")
    copies = w.join(v, same & (F.col("v.v") != F.col("w.v"))).select(name(F.col("v.graph_id"), F.col("v.v")).alias("graph_id"), F.col("w.v").alias("v"))
    e = edges.alias("e")
    copied = e.join(v, (F.col("e.graph_id") == F.col("v.graph_id")) & (F.col("v.v") != F.col("e.u")) & (F.col("v.v") != F.col("e.v"))).select(name(F.col("v.graph_id"), F.col("v.v")).alias("graph_id"), F.col("e.u").alias("u"), F.col("e.v").alias("v"))
    parts = components(copies, copied)
    beside = adjacency(edges).select(name(F.col("graph_id"), F.col("src")).alias("graph_id"), F.col("dst").alias("v"))
    split = parts.join(beside, V).groupBy("graph_id").agg(F.count_distinct("component").alias("k")).where("k > 1")
    return split.select(F.split("graph_id", "\x00")[0].alias("graph_id"), F.split("graph_id", "\x00")[1].cast("int").alias("v"))


def blocks(vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tree(graph_id, v, parent, block), edges(graph_id, u, v, block)): biconnected components, named by a vertex of each, for graphs larger than any task.

    A breadth-first forest has a tree edge above each vertex but the roots. Every other edge closes a
    cycle with the ways of its ends up to where these meet, and all tree edges of a cycle are in one
    block. Both ends climb together, pairs that have met each other on the way go on as one; rounds
    follow the depth of the forest, rows the edges. Tree edges that a cycle joins are then components
    (after Tarjan and Vishkin, 1985).
    """
    edges = written(edges)
    roots = components(vertices, edges).where("v = component").select(*V)
    tree = written(bfs(vertices, edges, roots).select(*V, "depth", "parent"))
    at = lambda c: tree.select("graph_id", F.col("v").alias(c), F.col("depth").alias(f"d{c}"), F.col("parent").alias(f"p{c}"))
    placed = edges.join(at("u"), ["graph_id", "u"]).join(at("v"), ["graph_id", "v"])
    tied = (F.col("pu").eqNullSafe(F.col("v"))) | (F.col("pv").eqNullSafe(F.col("u")))
    turned = F.when(F.col("du") > F.col("dv"), F.struct(F.col("u").alias("a"), F.col("v").alias("b"))).when(F.col("du") < F.col("dv"), F.struct(F.col("v").alias("a"), F.col("u").alias("b")))
    ends = placed.where(~tied).select("graph_id", F.coalesce(turned, F.struct(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))).alias("x"), (F.col("du") == F.col("dv")).alias("level"))
    front, joined = written(ends.select("graph_id", "x.a", "x.b", "level").distinct()), None
    up = tree.where("parent IS NOT NULL").select("graph_id", "v", "parent")
    while not front.isEmpty():
        # a is one deeper than b, or as deep: the deeper end climbs first, later both do
        one = front.join(up.select("graph_id", F.col("v").alias("a"), F.col("parent").alias("pa")), ["graph_id", "a"])
        both = one.join(up.select("graph_id", F.col("v").alias("b"), F.col("parent").alias("pb")), ["graph_id", "b"], "left")
        step = written(both.select("graph_id", "a", "b", "level", "pa", F.when(F.col("level"), F.col("pb")).alias("pb")))
        top = F.when(F.col("level"), F.col("pa") == F.col("pb")).otherwise(F.lit(False))
        # below the meeting place the tree edges above a and above pa are of one cycle; at it those above a and b
        pair = lambda a, c: F.struct(F.col(a).alias("a"), F.col(c).alias("c"))
        tied = F.when(top, F.array(pair("a", "b"))).when(F.col("level"), F.array(pair("a", "pa"), pair("b", "pb"))).otherwise(F.array(pair("a", "pa")))
        links = step.select("graph_id", F.explode(tied).alias("l"))
        links = written(links.select("graph_id", F.least("l.a", "l.c").alias("u"), F.greatest("l.a", "l.c").alias("v")).distinct())
        joined = links if joined is None else joined.unionAll(links)
        low, high = F.col("pa"), F.coalesce("pb", "b")
        front = written(step.where(~top).select("graph_id", F.least(low, high).alias("a"), F.greatest(low, high).alias("b"), F.lit(True).alias("level")).where("a != b").distinct())
    if joined is None:
        joined = edges.limit(0)
    named = components(up.select(*V), joined.distinct()).withColumnRenamed("component", "block")
    tree = written(tree.join(named, V, "left").select(*V, "parent", "block"))
    # an edge belongs where the tree edge above its deeper end does
    lower = placed.select("graph_id", "u", "v", F.when(F.col("du") >= F.col("dv"), F.col("u")).otherwise(F.col("v")).alias("w"))
    return tree, lower.join(named.withColumnRenamed("v", "w"), ["graph_id", "w"]).select("graph_id", "u", "v", "block")


def articulation_rounds(vertices: DataFrame, edges: DataFrame, whole: int = WHOLE) -> DataFrame:
    """(graph_id, v) whose removal splits a component: those whose edges lie in several blocks. A graph of at most whole vertices and edges is one row, and takes no rounds."""

    def found(nb, ids):
        return ([ids[i] for i in bg.bits(bg.articulation(nb, (1 << len(nb)) - 1))],)

    return _whole(vertices.select(*V), edges, _each(found, ["v"]), "graph_id string, v int", _by_blocks, whole)


def _by_blocks(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    both = blocks(vertices, edges)[1].select("graph_id", F.explode(F.array("u", "v")).alias("v"), "block")
    return both.groupBy(*V).agg(F.min("block").alias("low"), F.max("block").alias("high")).where("low != high").select(*V)


def contract(vertices: DataFrame, edges: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each graph with its set of members drawn together into the least of them; loops and repeats vanish."""
    into = members.groupBy("graph_id").agg(F.min("v").alias("_into"))
    to = members.distinct().join(into, "graph_id")
    new = lambda c: F.coalesce(F.col(f"_{c}"), F.col(c))
    moved = edges
    for c in ("u", "v"):
        moved = moved.join(to.select("graph_id", F.col("v").alias(c), F.col("_into").alias(f"_{c}")), ["graph_id", c], "left")
    merged = canonical_edges(moved.select("graph_id", new("u").alias("u"), new("v").alias("v")))
    left = vertices.join(to.select("graph_id", "v", "_into"), V, "left").select("graph_id", F.coalesce("_into", "v").alias("v")).distinct()
    return left, merged


def twins(vertices: DataFrame, edges: DataFrame, whole: int = WHOLE) -> DataFrame:
    """(graph_id, v, representative): vertices of equal open, or of equal closed, neighbourhood share the least of them. Graphs of more than whole vertices and edges are grouped by their neighbourhoods."""

    def found(nb, ids):
        opened, closed = {}, {}
        low = [min(opened.setdefault(x, v), closed.setdefault(x | 1 << i, v)) for i, (x, v) in enumerate(zip(nb, ids))]
        return ids, low

    return _whole(vertices.select(*V), edges, _each(found, ["v", "representative"]), "graph_id string, v int, representative int", _twins_by_keys, whole)


def _twins_by_keys(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    nb = neighbourhoods(vertices, edges)
    opened = nb.select(*V, F.lit(0).alias("kind"), F.col("nb").alias("key"))
    closed = nb.select(*V, F.lit(1).alias("kind"), F.array_sort(F.array_append("nb", F.col("v"))).alias("key"))
    keyed = opened.union(closed)
    least = keyed.groupBy("graph_id", "kind", "key").agg(F.min("v").alias("low"))
    return keyed.join(least, ["graph_id", "kind", "key"]).groupBy(*V).agg(F.min("low").alias("representative"))


def without_twins(vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graphs with one vertex of each class of twins."""
    kept = twins(vertices, edges).where("v = representative").select(*V)
    return kept, induced(edges, kept)


#: Partners of one vertex that one row of work of non_dominated meets.
PARTNERS = 10_000


def _undominated(nb: list[int], ids: list[int]) -> tuple[list[int]]:
    """Whoever dominates v is in, or next to, each of its neighbours."""
    degree, closed = [x.bit_count() for x in nb], [x | 1 << i for i, x in enumerate(nb)]
    out = []
    for v, x in enumerate(nb):
        able = (1 << len(nb)) - 1
        for y in bg.bits(x):
            able &= closed[y]
        if not any(degree[w] > degree[v] or (degree[w] == degree[v] and w < v) for w in bg.bits(able & ~(1 << v))):
            out.append(ids[v])
    return (out,)


def non_dominated(vertices: DataFrame, edges: DataFrame, members: DataFrame | None = None, partners: int = PARTNERS, whole: int = WHOLE) -> DataFrame:
    """(graph_id, v) of members (all vertices if None) that no other member dominates.

    v is dominated by w if all its neighbours but w are w's neighbours, and w has more neighbours, or
    as many and a smaller number. Among twins, told by 128-bit signatures of their neighbourhoods, the
    least dominates the others, and only it need be compared. A leaf is judged by what is counted around
    its neighbour. Any other vertex is compared with what is next to its neighbour of fewest neighbours,
    and that one itself, so no hub's neighbours are paired unless they have hubs alone beside them; then
    they are dealt to several rows. Pairs that the neighbour of next fewest neighbours leaves are counted.
    Without members, a graph of at most whole vertices and edges is one row, compared by bitmaps.
    """
    if members is None:
        rest = lambda v, e: _non_dominated(v, e, None, partners)
        return _whole(vertices.select(*V), edges, _each(_undominated, ["v"]), "graph_id string, v int", rest, whole)
    return _non_dominated(vertices, edges, members, partners)


def _non_dominated(vertices: DataFrame, edges: DataFrame, members: DataFrame | None, partners: int) -> DataFrame:
    among = (vertices if members is None else members).select(*V).distinct()
    adj = written(adjacency(edges))
    mix = lambda k, c: F.xxhash64(F.lit(k), F.col(c))
    signs = adj.groupBy("graph_id", F.col("src").alias("v"))
    signs = signs.agg(F.count("*").alias("degree"), F.bit_xor(mix(1, "dst")).alias("a"), F.bit_xor(mix(2, "dst")).alias("b"))
    signs = vertices.select(*V).distinct().join(signs, V, "left")
    signs = written(signs.select(*V, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("degree", "a", "b"))))
    own = signs.join(among, V, "left_semi")
    key = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"))
    keys = F.array(key(0, F.col("a"), F.col("b")), key(1, F.col("a").bitwiseXOR(mix(1, "v")), F.col("b").bitwiseXOR(mix(2, "v"))))
    keyed = own.select(*V, "degree", F.explode(keys).alias("key"))
    least = keyed.groupBy("graph_id", "degree", "key").agg(F.min("v").alias("low"), F.count("*").alias("n")).where("n > 1")
    twins_ = keyed.join(least, ["graph_id", "degree", "key"]).where("v != low").select(*V).distinct()
    alone = own.where("degree = 0").join(own.groupBy("graph_id").agg(F.max("degree").alias("top")), "graph_id").where("top > 0").select(*V)
    left = written(own.join(twins_, V, "left_anti").select(*V, "degree"))

    # (v, x): beside, with the neighbours of both
    beside = adj.select("graph_id", F.col("src").alias("v"), F.col("dst").alias("x")).join(left, V).join(signs.select("graph_id", F.col("v").alias("x"), F.col("degree").alias("dx")), ["graph_id", "x"])
    first = written(beside.groupBy(*V, "degree").agg(F.min(F.struct("dx", "x")).alias("near")).select(*V, "degree", F.col("near.x").alias("x"), F.col("near.dx").alias("dx")))
    mine = left.select("graph_id", F.col("v").alias("w"), F.col("degree").alias("dw"))
    better = (F.col("dw") > F.col("degree")) | ((F.col("dw") == F.col("degree")) & (F.col("w") < F.col("v")))
    around = adj.select("graph_id", F.col("src").alias("x"), F.col("dst").alias("w")).join(mine, ["graph_id", "w"])

    leaves = first.where("degree = 1")
    tops = around.groupBy("graph_id", "x").agg(F.max("dw").alias("top"))
    lost = leaves.join(tops, ["graph_id", "x"], "left").join(mine.withColumn("x", F.col("w")), ["graph_id", "x"], "left")
    lost = lost.where((F.col("top") > 1) | (F.col("w").isNotNull() & better)).select(*V)

    more = first.where("degree > 1")
    second = beside.join(more.select(*V, F.col("x").alias("x1")), V).where("x != x1").groupBy(*V).agg(F.min(F.struct("dx", "x")).alias("near"))
    more = written(more.join(second.select(*V, F.col("near.x").alias("x2")), V))
    slices = lambda d: F.ceil(d / partners).cast("int")
    asked = more.withColumn("salt", F.explode(F.sequence(F.lit(0), slices(F.col("dx")) - 1)))
    sized = around.join(more.groupBy("graph_id", "x").agg(F.max("dx").alias("dx")), ["graph_id", "x"])
    met = asked.join(sized.withColumn("salt", F.pmod(F.xxhash64("w"), slices(F.col("dx"))).cast("int")).drop("dx"), ["graph_id", "x", "salt"])
    met = met.select(*V, "degree", "w", "dw", "x2").unionByName(more.join(mine.withColumn("x", F.col("w")), ["graph_id", "x"]).select(*V, "degree", "w", "dw", "x2"))
    met = met.where((F.col("v") != F.col("w")) & better)
    known = adj.select("graph_id", F.col("src").alias("x2"), F.col("dst").alias("w"))
    met = written(met.where("w = x2").unionByName(met.where("w != x2").join(known, ["graph_id", "x2", "w"], "left_semi")))
    # neighbours of v, but w, that w has too
    to = lambda c: adj.select("graph_id", F.col("src").alias(c), F.col("dst").alias("y"))
    shared = met.select(*V, "w").join(to("v"), V).join(to("w").withColumn("has", F.lit(1)), ["graph_id", "w", "y"], "left")
    beaten = shared.where("y != w").groupBy(*V, "w").agg(F.count("*").alias("all"), F.count("has").alias("both")).where("all = both").select(*V).distinct()
    return among.join(twins_.unionAll(alone).unionAll(lost).unionAll(beaten).distinct(), V, "left_anti")


def super_ids(sets: DataFrame) -> DataFrame:
    """(graph_id, vset, id): a contracted set is named by its least member, so equal sets share a name and disjoint sets never do."""
    return sets.select("graph_id", "vset", F.array_min("vset").alias("id"))
