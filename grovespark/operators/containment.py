"""A containment index that stays: a table of sets in the shared folder that is appended to and asked again and again.

A set lies in the partition of its rarest element, and, for supersets, under each of its elements. How
rare an element is was counted when the index was made and stays as it was, so a set's place depends on
the set alone; elements not seen then are the rarest. A lookup reads only the partitions of the elements
that it asks for. Every insert is a batch of its own, which counts once its line in the manifest is
written, so a failed insert leaves nothing behind that is read.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PARTS = 64
SETS = "entry long, word array<int>, key int, batch string, part int"
MEMBERS = "e int, entry long, word array<int>, batch string, part int"


def _part(element: Column) -> Column:
    """The partition of an element; the empty set, which has none, lies in one of its own."""
    return F.when(element.isNull(), PARTS).otherwise(F.pmod(F.xxhash64(element), F.lit(PARTS))).cast("int")


@dataclass
class Index:
    spark: SparkSession
    path: str

    @classmethod
    def create(cls, sample: DataFrame, path: str) -> Index:
        """A new index at path, empty; sample (word) tells which elements are frequent."""
        counts = sample.select(F.explode("word").alias("e")).groupBy("e").agg(F.count("*").alias("n"))
        counts.write.parquet(f"{path}/counts")
        out = cls(sample.sparkSession, path)
        out._commit(None)
        return out

    def _commit(self, batch: str | None) -> None:
        self.spark.createDataFrame([(batch,)], "batch string").coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def _read(self, name: str, schema: str, parts: list[int] | None = None) -> DataFrame:
        """The rows of finished batches, of these partitions if given."""
        done = [r[0] for r in self.spark.read.parquet(f"{self.path}/manifest").collect() if r[0]]  # a row for each insert
        if not done:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/{name}").where(F.col("batch").isin(done))
        return rows if parts is None else rows.where(F.col("part").isin(parts))

    def _keyed(self, words: DataFrame) -> DataFrame:
        """words (id, word) with key, the rarest element, and part."""
        often = self.spark.read.schema("e int, n long").parquet(f"{self.path}/counts")
        each = words.select("id", F.explode("word").alias("e")).join(often, "e", "left")
        keys = each.groupBy("id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "e")).alias("k"))
        return words.join(keys, "id", "left").select("id", "word", F.col("k.e").alias("key"), _part(F.col("k.e")).alias("part"))

    def _parts(self, rows: DataFrame) -> list[int]:
        return [r[0] for r in rows.select("part").distinct().collect()]  # PARTS + 1 at most

    def sets(self) -> DataFrame:
        """(entry, word) of all sets."""
        return self._read("sets", SETS).select("entry", "word")

    def insert(self, words: DataFrame) -> DataFrame:
        """(set_id, entry, new) of words (set_id, word), ascending arrays, ids that no insert had before: the id under which each set is stored, and whether it was stored by this row.

        Of equal words of one insert the row of the least id stores the set.
        """
        batch = uuid.uuid4().hex
        keyed = self._keyed(words.select(F.col("set_id").cast("long").alias("id"), F.col("word").cast("array<int>").alias("word")))
        keyed.write.parquet(f"{self.path}/asked/{batch}")
        keyed = self.spark.read.schema("id long, word array<int>, key int, part int").parquet(f"{self.path}/asked/{batch}")
        known = self._read("sets", SETS, self._parts(keyed)).select("entry", "word")
        first = keyed.groupBy("word").agg(F.min("id").alias("first"), F.first("key").alias("key"), F.first("part").alias("part"))
        named = first.join(known, "word", "left").select("word", "key", "part", F.coalesce("entry", "first").alias("entry"), F.col("entry").isNull().alias("fresh"))
        named.write.parquet(f"{self.path}/named/{batch}")
        named = self.spark.read.schema("word array<int>, key int, part int, entry long, fresh boolean").parquet(f"{self.path}/named/{batch}")
        new = named.where("fresh").select("entry", "word", "key", F.lit(batch).alias("batch"), "part")
        new.repartition("part").write.mode("append").partitionBy("batch", "part").parquet(f"{self.path}/sets")
        members = new.select(F.explode_outer("word").alias("e"), "entry", "word", "batch").withColumn("part", _part(F.col("e")))
        members.repartition("part", F.pmod(F.xxhash64("entry"), F.lit(8))).write.mode("append").partitionBy("batch", "part").parquet(f"{self.path}/members")
        self._commit(batch)
        return keyed.join(named, "word").select(F.col("id").alias("set_id"), "entry", (F.col("fresh") & (F.col("id") == F.col("entry"))).alias("new"))

    def search(self, queries: DataFrame) -> DataFrame:
        """(query_id, entry): the entry of exactly this set, null if it is not stored."""
        asked = self._keyed(queries.select(F.col("query_id").alias("id"), "word"))
        known = self._read("sets", SETS, self._parts(asked)).select("entry", "word")
        return asked.join(known, "word", "left").select(F.col("id").alias("query_id"), "entry")

    def subsets(self, queries: DataFrame, gap: int | None = None) -> DataFrame:
        """(query_id, entry, gap): stored sets within each query, and how many elements they leave out; at most gap of them if given."""
        asked = queries.select("query_id", "word", F.explode(F.array_append(F.col("word").cast("array<int>"), F.lit(None).cast("int"))).alias("e"))
        asked = asked.withColumn("part", _part(F.col("e")))
        known = self._read("sets", SETS, self._parts(asked)).select("entry", F.col("word").alias("stored"), F.col("key").alias("e"))
        within = (F.size("stored") <= F.size("word")) & (F.size(F.array_except("stored", "word")) == 0)
        left = (F.size("word") - F.size("stored")).cast("long")
        found = asked.alias("q").join(known.alias("s"), F.col("q.e").eqNullSafe(F.col("s.e"))).where(within).select("query_id", "entry", left.alias("gap"))
        return found if gap is None else found.where(F.col("gap") <= gap)

    def supersets(self, queries: DataFrame) -> DataFrame:
        """(query_id, entry): stored sets that hold each query, looked up under its rarest element alone; the empty query is in all."""
        asked = self._keyed(queries.select(F.col("query_id").alias("id"), F.col("word").cast("array<int>").alias("word")))
        some, none = asked.where("key IS NOT NULL"), asked.where("key IS NULL")
        under = self._read("members", MEMBERS, self._parts(some)).select(F.col("e").alias("key"), "entry", F.col("word").alias("stored"))
        met = some.join(under, "key").where((F.size("stored") >= F.size("word")) & (F.size(F.array_except("word", "stored")) == 0))
        # the answer to the empty query is the whole table: a row of each for every one that asks so
        every = self.sets().select("entry", F.lit(True).alias("all")).join(none.select("id", F.lit(True).alias("all")), "all")
        return met.select("id", "entry").unionAll(every.select("id", "entry")).select(F.col("id").alias("query_id"), "entry")
