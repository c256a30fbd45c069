"""What the text operators share: tables, the shared folder and bounded Arrow batches."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches: rows and bytes, so that a batch of very long texts still fits a worker.
BATCH_ROWS = 1000
BATCH_BYTES = 2 << 20

ASCII_SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Make Arrow batches small enough for texts of any length.

    The settings stay with the session: batches are cut when a plan runs, long after it was made.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


@functools.lru_cache(maxsize=None)
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="grovespark-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a local master may leave it unset; a folder of this machine serves then.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir for local-cluster masters")
    return _own_folder()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """names, each with underscores before it until no column of df has it, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Rows, and characters and array elements in all, of a table that is broadcast; larger ones are joined as Spark sees fit.
BROADCAST_ROWS = 50_000
BROADCAST_CELLS = 4_000_000


def few(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, a written table, marked for a broadcast if it has no more than so many rows, and no more than BROADCAST_CELLS in them."""
    wide = [F.length(F.col(c)) if kind == "string" else F.size(F.col(c)) for c, kind in df.dtypes if kind == "string" or kind.startswith("array")]
    cells = sum((F.coalesce(F.sum(w), F.lit(0)) for w in wide), F.lit(0))
    size = df.agg(F.count("*").alias("rows"), cells.alias("cells")).first()
    return F.broadcast(df) if size["rows"] <= rows and size["cells"] <= BROADCAST_CELLS else df


def small(df: DataFrame, name: str, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df staged, and marked for a broadcast if it is small."""
    return few(staged(df, name), rows)


def own(df: DataFrame, names: list[str] | None = None) -> list[Column]:
    """The columns of df, or those of these names, whatever characters their names have."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in (df.columns if names is None else names)]


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends here, lost executors cost nothing."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
