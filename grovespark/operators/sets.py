"""Containment among families of sets, through an index from elements to sets.

sets(set_id, word) and queries(query_id, word), words ascending arrays. Only sets that share an
element meet; empty ones have an index entry of their own. The empty set is a subset of every query,
and every stored set is a superset of the empty query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_ascending(word: Column) -> Column:
    return word == F.array_sort(F.array_distinct(word))


def insert(bounds: DataFrame, more: DataFrame) -> DataFrame:
    """bounds(vset, lb, ub, root) with more merged in: the best bounds of each set, the root of its least upper bound."""
    return bounds.unionByName(more).groupBy("vset").agg(F.max("lb").alias("lb"), F.min("ub").alias("ub"), F.min_by("root", F.struct("ub", "root")).alias("root"))


def size(sets: DataFrame) -> DataFrame:
    return sets.select("word").distinct().agg(F.count("*").alias("n"))


def search(sets: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, found): whether exactly this set is stored."""
    hit = queries.join(sets, "word", "left_semi").select("query_id").withColumn("found", F.lit(True))
    return queries.select("query_id").join(hit, "query_id", "left").select("query_id", F.coalesce("found", F.lit(False)).alias("found"))


def _elements(word: str, extra: Column | None = None) -> Column:
    """The index entries of a set: its elements, and a null one if extra holds."""
    x = F.transform(word, lambda e: F.struct(e.cast("long").alias("e")))
    none = F.array(F.struct(F.lit(None).cast("long").alias("e")))
    return x if extra is None else F.concat(x, F.when(extra, none).otherwise(F.array().cast("array<struct<e: bigint>>")))


def _rarest(words: DataFrame, sets: DataFrame, key: str) -> DataFrame:
    """words with x, the element of each that fewest stored sets have: what a match must share anyway, and seldom shares by chance; of empty words the null entry."""
    often = sets.select(F.explode("word").alias("e")).groupBy("e").agg(F.count("*").alias("n"))
    each = words.select(key, F.explode("word").alias("e")).join(often, "e", "left")
    pick = each.groupBy(key).agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "e")).alias("r"))
    return words.join(pick, key, "left").select(key, "word", F.struct(F.col("r.e").cast("long").alias("e")).alias("x"))


def all_subsets(sets: DataFrame, queries: DataFrame, gap: int | None = None) -> DataFrame:
    """(query_id, set_id, gap): stored sets within each query, and how many elements they leave out; at most gap of them if given.

    A stored set is indexed by its rarest element alone; a query looks under each of its own, and for empty sets.
    """
    s = _rarest(sets, sets, "set_id").select("set_id", F.col("word").alias("stored"), "x")
    q = queries.select("query_id", "word", F.explode(_elements("word", F.lit(True))).alias("x"))
    within = (F.size("stored") <= F.size("word")) & (F.size(F.array_except("stored", "word")) == 0)
    found = q.join(s, "x").where(within).select("query_id", "set_id", (F.size("word") - F.size("stored")).cast("long").alias("gap"))
    return found if gap is None else found.where(F.col("gap") <= gap)


def all_supersets(sets: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, set_id): stored sets that hold each query, looked up by the query's rarest element alone; every set holds the empty query."""
    q = _rarest(queries, sets, "query_id")
    s = sets.select("set_id", F.col("word").alias("stored"), F.explode(_elements("word", F.lit(True))).alias("x"))
    within = (F.size("stored") >= F.size("word")) & (F.size(F.array_except("word", "stored")) == 0)
    return q.join(s, "x").where(within).select("query_id", "set_id")


def has_subset(sets: DataFrame, queries: DataFrame) -> DataFrame:
    hit = all_subsets(sets, queries).select("query_id").distinct().withColumn("found", F.lit(True))
    return queries.select("query_id").join(hit, "query_id", "left").select("query_id", F.coalesce("found", F.lit(False)).alias("found"))


def has_superset(sets: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, found); the empty query has one always."""
    hit = all_supersets(sets, queries).select("query_id").distinct().withColumn("found", F.lit(True))
    return queries.join(hit, "query_id", "left").select("query_id", F.coalesce("found", F.size("word") == 0).alias("found"))
