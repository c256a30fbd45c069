"""Fixpoint rounds: each round's table goes to the shared folder, so lineage stays short and survives lost executors."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.lru_cache(maxsize=None)
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="grovespark-")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only plain local masters may leave it unset."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _own_folder()


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    path = new_folder(df.sparkSession, "round")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
