"""Canonical forms of components: whatever depends on the structure alone is worked out once for each form.

A form writes a connected graph down in an order that equal graphs share (bitgraph.canonical), so it is
a key to group and join by, and the order leads back to each graph's own vertices.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovespark.functions import bitgraph as bg
from grovespark.functions.loops import written
from grovespark.operators.kernels import per_graph

#: Bytes of solved forms that are broadcast to where their graphs are; more are joined as Spark sees fit.
BROADCAST_BYTES = 8 << 20
#: Components whose forms a task remembers.
KNOWN = 100_000
SOLVED = "form binary, lower int, upper int, parent array<int>"


def forms(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, part, form, vs): a row for each component, vs its vertices in the order of its form."""

    def kernel(nb, ids):
        for k, part in enumerate(bg.components(nb, (1 << len(nb)) - 1)):
            form, order = bg.canonical(nb, part)
            yield k, form, [ids[v] for v in order]

    return per_graph(vertices, edges, kernel, "graph_id string, part int, form binary, vs array<int>")


def forms_of_rows(rows: DataFrame, key: str) -> DataFrame:
    """(key, form, vs) of the components of rows (key, n, es), es by places as u * 2^32 + v; vs are places from 0 on. A component met before in a task is not written down again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[int, ...], tuple[bytes, list[int]]] = {}
        for batch in batches:
            keys, found, orders = [], [], []
            for name, n, es in zip(*(batch.column(c).to_pylist() for c in (key, "n", "es"))):
                nb = bg.build(n, ((e >> 32, e & 0xFFFFFFFF) for e in es))
                for part in bg.components(nb, (1 << n) - 1):
                    ids = list(bg.bits(part))
                    at = {v: i for i, v in enumerate(ids)}
                    own = tuple(sum(1 << at[w] for w in bg.bits(nb[v])) for v in ids)
                    if own not in known:
                        if len(known) >= KNOWN:
                            known.clear()
                        known[own] = bg.canonical(list(own), (1 << len(own)) - 1)
                    form, order = known[own]
                    keys.append(name)
                    found.append(form)
                    orders.append([ids[i] for i in order])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(found, pa.binary()), pa.array(orders, pa.list_(pa.int32()))], names=[key, "form", "vs"])

    return rows.select(key, "n", "es").mapInArrow(run, f"{key} long, form binary, vs array<int>")


def graphs_of(named: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of the distinct forms of named (form), graph_id the form in hexadecimal digits, vertices by place from 1 on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [bg.of_form(form) for form in batch.column("form").to_pylist()]
            ends = [[(i + 1 << 32) + j + 1 for i, near in enumerate(nb) for j in bg.bits(near) if i < j] for nb in found]
            yield pa.RecordBatch.from_arrays([batch.column("form"), pa.array([len(nb) for nb in found], pa.int32()), pa.array(ends, pa.list_(pa.int64()))], names=["form", "n", "es"])

    rows = written(named.select("form").distinct().mapInArrow(run, "form binary, n int, es array<long>").select(F.hex("form").alias("graph_id"), "n", "es"))
    edges = rows.select("graph_id", F.explode("es").alias("e")).select("graph_id", F.shiftright("e", 32).cast("int").alias("u"), F.expr("cast(e & 4294967295 AS int)").alias("v"))
    return rows.select("graph_id", F.explode(F.expr("sequence(1, n)")).alias("v")), edges


def solve_forms(named: DataFrame, seconds: float | None = None) -> DataFrame:
    """(form, lower, upper, parent[]) of each form of named (form): bounds of its treedepth and a tree of depth upper, by places from 1 on, 0 a root."""
    parts = int(named.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for form in batch.column("form").to_pylist():
                nb = bg.of_form(form)
                solver, whole = bg.Solver(nb, seconds), (1 << len(nb)) - 1
                lower, upper = solver.solve(whole)
                tree = solver.tree(whole)
                out.append((form, lower, upper, [tree[v] + 1 for v in range(len(nb))]))
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int32(), pa.int32(), pa.list_(pa.int32())))], names=["form", "lower", "upper", "parent"])

    # a fixed number of parts: small rows are long work, which would meet in one task otherwise
    return named.select("form").distinct().repartition(parts, "form").mapInArrow(run, SOLVED)


def solve(vertices: DataFrame, edges: DataFrame, seconds: float | None = None) -> DataFrame:
    """The rows of kernels.solve, every form of a component solved once; the seconds are for a form.

    Ids are from 1 on, as 0 stands for a root.
    """
    named = written(forms(vertices, edges))
    solved = written(solve_forms(named, seconds))
    size = solved.agg(F.coalesce(F.sum(F.length("form") + 4 * F.size("parent") + 64), F.lit(0))).first()[0]
    each = named.join(F.broadcast(solved) if size <= BROADCAST_BYTES else solved, "form")
    parent = F.transform("parent", lambda p: F.when(p == 0, 0).otherwise(F.get("vs", p - 1)))
    rows = each.select("graph_id", "vs", "lower", "upper", F.transform(F.arrays_zip("vs", parent.alias("up")), lambda x: F.struct(x["vs"].alias("v"), x["up"].alias("p"))).alias("tree"))
    m = edges.groupBy("graph_id").agg(F.count("*").cast("int").alias("m"))
    whole = rows.groupBy("graph_id").agg(F.max("lower").alias("lb"), F.max("upper").alias("ub"), F.array_sort(F.flatten(F.collect_list("tree"))).alias("t")).join(m, "graph_id", "left")
    exact = F.col("lb") == F.col("ub")
    return whole.select(
        "graph_id", F.size("t").alias("n"), F.coalesce("m", F.lit(0)).alias("m"), "lb", "ub", F.when(exact, F.col("lb")).alias("td"),
        F.when(exact, "exact").otherwise("bounded").alias("status"), F.col("t.v").alias("v"), F.col("t.p").alias("parent"),
    )
