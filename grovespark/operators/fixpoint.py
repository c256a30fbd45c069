"""Exact treedepth as a fixpoint over tables, with the forest that proves it: states, choices and children.

A state is a connected vertex set, a bitmap over its graph's vertices as in separators.py. A state that
is open has as choices its fully minimal separators; the components beside one are its children.
Treedepth is the least, over the choices, of a separator's size and the largest treedepth of its
children. Going down, each state is expanded once, by rounds for all graphs together. Going up, each
round touches only the choices that have a child whose value is new. The best choice of each state is
kept, and expanded from the roots down it is an elimination forest.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovespark.functions import bitgraph as bg
from grovespark.functions.loops import written
from grovespark.operators import forms
from grovespark.operators.kernels import packed
from grovespark.operators.separators import _bytes, _in_chunks

STATE = ["graph_id", "state"]
CHOICE = [*STATE, "sep"]
#: Vertices of shapes that are broadcast: there are 1099 graphs of one to five numbered vertices.
SMALL = 5


@dataclass
class Solved:
    """values(graph_id, state, td, sep): treedepth of each state met and the separator of its best choice, null where its own tree is as low."""

    graphs: DataFrame
    roots: DataFrame
    choices: DataFrame
    values: DataFrame

    def treedepth(self) -> DataFrame:
        """(graph_id, td): that of the deepest component."""
        return self.roots.join(self.values, STATE).groupBy("graph_id").agg(F.max("td").alias("td"))

    def forest(self) -> DataFrame:
        """(graph_id, v, parent), parent 0 a root: best choices from the roots down, a level of choices in each round."""

        def own(nb, ids, masks):
            for mask in masks:
                for v, up in bg.own_tree(nb, mask)[1].items():
                    yield _bytes(mask, len(nb)), ids[v], None if up < 0 else ids[up]

        def members(nb, ids, masks):
            return ((_bytes(m, len(nb)), [ids[i] for i in bg.bits(m)]) for m in masks)

        front, out = written(self.roots.withColumn("above", F.lit(0))), None
        while not front.isEmpty():
            best = written(front.join(self.values.select(*STATE, "sep"), STATE))
            plain, split = best.where("sep IS NULL"), best.where("sep IS NOT NULL")
            trees = _in_chunks(self.graphs, plain.select("graph_id", F.col("state").alias("sep")), own, "graph_id string, state binary, v int, up int")
            rows = trees.join(plain.select(*STATE, "above"), STATE).select("graph_id", "v", F.coalesce("up", "above").alias("parent"))
            names = _in_chunks(self.graphs, split.select("graph_id", "sep").distinct(), members, "graph_id string, sep binary, vs array<int>")
            chains = written(split.join(names, ["graph_id", "sep"]))
            line = chains.select("graph_id", "above", "vs", F.posexplode("vs").alias("k", "v"))
            line = line.select("graph_id", "v", F.when(F.col("k") == 0, F.col("above")).otherwise(F.get("vs", F.col("k") - 1)).alias("parent"))
            level = written(rows.unionAll(line))
            out = level if out is None else out.unionAll(level)
            front = written(chains.select(*CHOICE, F.element_at("vs", -1).alias("above")).join(self.choices, CHOICE).select("graph_id", F.col("child").alias("state"), "above"))
        return front.select("graph_id", F.col("above").alias("v"), F.col("above").alias("parent")) if out is None else out


def _expand(nb, ids, masks):
    """(state, lower, upper, sep, child) of the choices that may be lower than the state's own tree, and a row of the bounds alone."""
    known: dict[int, int] = {}

    def lower(mask: int) -> int:
        if mask not in known:
            got = bg.closed_form(nb, mask)
            known[mask] = got[0] if got else bg.lower_bound(nb, mask)
        return known[mask]

    for mask in masks:
        state, low, up = _bytes(mask, len(nb)), lower(mask), bg.own_tree(nb, mask)[0]
        yield state, low, up, None, None
        if low < up:
            for sep in bg.minimal_separators(nb, mask):
                parts, size = bg.components(nb, mask & ~sep), sep.bit_count()
                if size + max(map(lower, parts)) < up and bg.is_fully_minimal(nb, mask, sep):
                    for part in parts:
                        yield state, low, up, _bytes(sep, len(nb)), _bytes(part, len(nb))


def solve(vertices: DataFrame, edges: DataFrame) -> Solved:
    """All states that the components of the graphs lead to, with their values; graphs of any width."""
    graphs = written(packed(vertices, edges))
    start = lambda nb, ids, masks: ((_bytes(c, len(nb)),) for m in masks for c in bg.components(nb, m))
    whole = graphs.select("graph_id", F.expr("unhex(concat(repeat('FF', size(vs) div 8), if(size(vs) % 8 > 0, lpad(hex(shiftleft(1, size(vs) % 8) - 1), 2, '0'), '')))").alias("sep"))
    roots = written(_in_chunks(graphs, whole, start, "graph_id string, state binary"))
    front, known, steps = roots, roots, None
    while not front.isEmpty():
        step = written(_in_chunks(graphs, front.withColumnRenamed("state", "sep"), _expand, "graph_id string, state binary, lower int, upper int, sep binary, child binary"))
        steps = step if steps is None else steps.unionAll(step)
        front = written(step.where("child IS NOT NULL").select("graph_id", F.col("child").alias("state")).distinct().join(known, STATE, "left_anti"))
        known = known.unionAll(front)
    if steps is None:
        values = roots.withColumn("td", F.lit(0)).withColumn("sep", F.lit(None).cast("binary"))
        return Solved(graphs, roots, roots.withColumn("sep", F.col("state")).withColumn("child", F.col("state")), values)
    choices = written(steps.where("sep IS NOT NULL").select(*CHOICE, "child"))
    asked = written(choices.groupBy(*CHOICE).agg(F.count("*").alias("children")))
    bounds = steps.where("sep IS NULL").select(*STATE, "upper").join(asked.groupBy(*STATE).agg(F.count("*").alias("wanted")), STATE, "left")
    bounds = written(bounds.select(*STATE, "upper", F.coalesce("wanted", F.lit(0)).alias("wanted")))
    new = written(bounds.where("wanted = 0").select(*STATE, F.col("upper").alias("td"), F.lit(None).cast("binary").alias("sep")))
    values = new
    size = F.expr("aggregate(transform(sequence(1, length(sep)), i -> bit_count(cast(conv(hex(substring(sep, i, 1)), 16, 10) AS int))), 0, (a, b) -> a + b)")
    waiting = asked.select(*CHOICE, "children", F.lit(0).cast("long").alias("got"), F.lit(0).alias("worst"))
    judged = bounds.where("wanted > 0").select(*STATE, "upper", "wanted", F.lit(0).cast("long").alias("got"), F.struct(F.col("upper").alias("cost"), F.lit(None).cast("binary").alias("sep")).alias("best"))
    while not new.isEmpty():
        # only choices that a new value touches, then only states that a finished choice touches
        heard = choices.join(new.select("graph_id", F.col("state").alias("child"), "td"), ["graph_id", "child"]).groupBy(*CHOICE).agg(F.count("*").alias("more"), F.max("td").alias("t"))
        got = (F.col("got") + F.coalesce("more", F.lit(0))).alias("got")
        now = written(waiting.join(heard, CHOICE, "left").select(*CHOICE, "children", got, F.greatest("worst", F.coalesce("t", F.lit(0))).alias("worst")))
        waiting = now.where("got < children")
        offer = F.struct((size + F.col("worst")).cast("int").alias("cost"), "sep").alias("offer")
        ready = now.where("got = children").select(*STATE, offer).groupBy(*STATE).agg(F.count("*").alias("more"), F.min("offer").alias("offer"))
        both = judged.join(ready, STATE, "left")
        better = F.when(F.col("offer.cost") < F.col("best.cost"), F.col("offer")).otherwise(F.col("best"))
        state = written(both.select(*STATE, "upper", "wanted", got, better.alias("best")))
        judged = state.where("got < wanted")
        new = state.where("got = wanted").select(*STATE, F.col("best.cost").alias("td"), F.col("best.sep").alias("sep"))
        values = values.unionAll(new)
    return Solved(graphs, roots, choices, written(values))


def forests_of_rows(rows: DataFrame) -> DataFrame:
    """(graph_id, vs, es, up) of rows (graph_id, vs, es), es sorted places in vs as u * 2^32 + v: up has the parent of each vertex in its graph's forest, as a place from 1 on, 0 a root.

    Graphs of equal n and es are one shape, its components have forms, and the fixpoint solves each form
    once. Shapes of at most SMALL vertices are so few that they are broadcast, and they are the ones
    that very many graphs share; graphs of others are joined by shape.
    """
    rows = rows.withColumn("n", F.size("vs"))
    shapes = written(rows.groupBy("n", "es").agg(F.lit(0).alias("_")).select("n", "es", F.monotonically_increasing_id().alias("shape")))
    # a fixed number of parts: small rows are long work
    parts = written(forms.forms_of_rows(shapes.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "shape"), "shape"))
    forest = solve(*forms.graphs_of(parts)).forest()
    solved = written(forest.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("v", "parent"))).alias("t")).select(F.unhex("graph_id").alias("form"), F.col("t.parent").alias("parent")))
    size = solved.agg(F.coalesce(F.sum(F.length("form") + 4 * F.size("parent") + 64), F.lit(0))).first()[0]
    each = parts.join(F.broadcast(solved) if size <= forms.BROADCAST_BYTES else solved, "form")
    tree = F.expr("transform(vs, (v, i) -> named_struct('v', v, 'p', if(parent[i] = 0, 0, vs[parent[i] - 1] + 1)))")
    whole = each.select("shape", tree.alias("t")).groupBy("shape").agg(F.array_sort(F.flatten(F.collect_list("t"))).alias("t"))
    trees = written(shapes.join(whole, "shape").select("n", "es", F.col("t.p").alias("up")))
    few, many = f"n <= {SMALL}", f"n > {SMALL}"
    out = rows.where(few).join(F.broadcast(trees.where(few)), ["n", "es"]).unionByName(rows.where(many).join(trees.where(many), ["n", "es"]))
    return out.select("graph_id", "vs", "es", "up")
