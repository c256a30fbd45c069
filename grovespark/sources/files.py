"""Text formats: .gr graphs, .tree forests, result lines and timing tables. One file is one graph, named by its stem."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grovespark.operators.graph import canonical_edges


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def _lines(spark: SparkSession, paths) -> DataFrame:
    text = spark.read.text(paths)
    return text.select(_name(text).alias("graph_id"), F.regexp_replace("value", r"\r", "").alias("line"))


def _name(text: DataFrame) -> Column:
    """The folder graph_id=... that write_texts makes, or else the stem of the file."""
    return F.col("graph_id").cast("string") if "graph_id" in text.columns else stem(F.col("_metadata.file_path"))


def read_gr(spark: SparkSession, paths, mode: str = "STRICT") -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of .gr files: a line 'p tdp N M', then an edge a line; lines of 'c' are comments.

    Loops and repeats are dropped. STRICT raises, when read, on a file whose number of edge lines is
    not M, whose ends are out of range, or with other lines; PERMISSIVE takes what is there.
    """
    if mode not in ("STRICT", "PERMISSIVE"):
        raise ValueError(mode)
    lines = _lines(spark, paths).where(~F.col("line").rlike(r"^c(\s|$)"))
    part = F.split(F.trim("line"), r"\s+")
    kind = F.when(F.col("line").rlike(r"^p\s+tdp\s+\d+\s+\d+\s*$"), "p").when(F.col("line").rlike(r"^\s*\d+\s+\d+\s*$"), "e").otherwise("x")
    parsed = lines.select("graph_id", "line", kind.alias("kind"), part.alias("part"))
    heads = parsed.where("kind = 'p'").select("graph_id", F.get("part", F.lit(2)).cast("int").alias("n"), F.get("part", F.lit(3)).cast("int").alias("m"))
    pairs = parsed.where("kind = 'e'").select("graph_id", F.get("part", F.lit(0)).cast("int").alias("u"), F.get("part", F.lit(1)).cast("int").alias("v"))
    if mode == "STRICT":
        seen = parsed.groupBy("graph_id").agg(F.count_if(F.col("kind") == "p").alias("p"), F.count_if(F.col("kind") == "e").alias("e"), F.count_if(F.col("kind") == "x").alias("x"))
        top = pairs.groupBy("graph_id").agg(F.max(F.greatest("u", "v")).alias("top"), F.min(F.least("u", "v")).alias("low"))
        state = seen.join(heads, "graph_id", "left").join(top, "graph_id", "left")
        bad = (F.col("p") != 1) | (F.col("x") > 0) | (F.col("e") != F.coalesce("m", F.lit(-1))) | (F.coalesce("top", F.lit(0)) > F.col("n")) | (F.coalesce("low", F.lit(1)) < 1)
        heads = state.select("graph_id", F.when(bad, F.raise_error(F.concat(F.lit("malformed graph file "), "graph_id"))).otherwise(F.col("n")).cast("int").alias("n"))
        pairs = pairs.join(heads.where("n IS NOT NULL").select("graph_id"), "graph_id")
    vertices = heads.where("n > 0").select("graph_id", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("v"))
    return vertices, canonical_edges(pairs)


def malformed(spark: SparkSession, paths) -> DataFrame:
    """(graph_id, declared, found) of .gr files whose edge lines are not as many as declared."""
    lines = _lines(spark, paths)
    m = F.max(F.when(F.col("line").rlike(r"^p\s+tdp\s"), F.get(F.split("line", r"\s+"), F.lit(3)).cast("long")))
    return lines.groupBy("graph_id").agg(m.alias("declared"), F.count_if(F.col("line").rlike(r"^\s*\d+\s+\d+\s*$")).alias("found")).where("declared IS NULL OR declared != found")


def read_tree(spark: SparkSession, paths) -> tuple[DataFrame, DataFrame]:
    """(declared(graph_id, depth), tree(graph_id, v, parent)) of .tree files; a file is read whole, as a line's place is its vertex."""
    text = spark.read.text(paths, wholetext=True)
    rows = text.select(_name(text).alias("graph_id"), F.array_remove(F.split(F.col("value"), r"\s+"), "").alias("x"))
    declared = rows.select("graph_id", F.get("x", F.lit(0)).cast("int").alias("depth"))
    tree = rows.select("graph_id", F.posexplode("x").alias("v", "parent")).where("v > 0").select("graph_id", "v", F.col("parent").cast("int").alias("parent"))
    return declared, tree


def gr_text(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, value): the text of each graph's .gr file; vertices must be 1 to n."""
    n = vertices.groupBy("graph_id").agg(F.count("*").alias("n"))
    body = edges.groupBy("graph_id").agg(F.count("*").alias("m"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("u", "v"))), lambda e: F.concat_ws(" ", e["u"].cast("string"), e["v"].cast("string"))), "\n").alias("body"))
    return n.join(body, "graph_id", "left").select("graph_id", F.concat_ws("\n", F.format_string("p tdp %d %d", "n", F.coalesce("m", F.lit(0))), "body").alias("value"))


def tree_text(declared: DataFrame, tree: DataFrame) -> DataFrame:
    """(graph_id, value): the text of each graph's .tree file."""
    body = tree.groupBy("graph_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("v", "parent"))), lambda e: e["parent"].cast("string")), "\n").alias("body"))
    return declared.join(body, "graph_id").select("graph_id", F.concat_ws("\n", F.col("depth").cast("string"), "body").alias("value"))


def write_texts(texts: DataFrame, path: str) -> None:
    """One folder per graph under path, which the readers take for the graph's name."""
    texts.write.partitionBy("graph_id").text(path)


def read_timings(spark: SparkSession, paths) -> DataFrame:
    """records(run, instance, td, seconds, error) of CSV files fn,treedepth,time,error with or without header."""
    schema = "fn string, treedepth string, time string, error string"
    rows = spark.read.schema(schema).csv(paths).select(stem(F.col("_metadata.file_path")).alias("run"), "*").where("fn != 'fn'")
    return rows.select("run", F.trim("fn").alias("instance"), F.expr("try_cast(trim(treedepth) AS int)").alias("td"), F.expr("try_cast(trim(time) AS double)").alias("seconds"), "error")


def random_trees(spark: SparkSession, graphs: int, n: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """graphs random trees of n vertices: each vertex but the first hangs on a random earlier one."""
    ids = spark.range(graphs).select(F.concat(F.lit("tree_"), F.col("id").cast("string")).alias("graph_id"))
    vertices = ids.select("graph_id", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("v"))
    up = F.expr(f"cast(pmod(xxhash64(graph_id, v, {seed}), v - 1) AS int) + 1")
    return vertices, vertices.where("v > 1").select("graph_id", up.alias("u"), "v")
