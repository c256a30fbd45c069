"""Reports over timing records(run, instance, td, seconds); td -1 or null is unsolved."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_run(records: DataFrame) -> DataFrame:
    done = records.where("td > -1")
    solved = done.groupBy("run").agg(F.count("*").alias("solved"), F.sum("seconds").alias("total_s"), F.avg("seconds").alias("mean_s"))
    return records.groupBy("run").agg(F.count("*").alias("attempted")).join(solved, "run", "left").fillna(0, ["solved"])


def mismatches(records: DataFrame) -> DataFrame:
    """Records whose td is not the least that any run found for the instance."""
    done = records.where("td > -1")
    return done.join(done.groupBy("instance").agg(F.min("td").alias("least")), "instance").where("td != least")


def fastest(records: DataFrame) -> DataFrame:
    return records.where("td > -1").groupBy("instance").agg(F.min("td").alias("td"), F.min("seconds").alias("seconds"), F.min_by("run", F.struct("seconds", "run")).alias("run"))
