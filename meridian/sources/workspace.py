"""Places for tables that jobs write between steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that the cluster names; without one only a local session has a folder, of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"{tempfile.gettempdir()}/checkpoints"
    return f"{base.rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read back, for a frame that is used more than once."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows up to which a table is broadcast: of narrow rows, and of rows with up to 60 numbers.
FEW_ROWS, FEW_WIDE_ROWS = 400_000, 100_000


def few(table: DataFrame, most: int = FEW_ROWS) -> DataFrame:
    """A written table for a join: broadcast if its rows are few, else as it is."""
    return F.broadcast(table) if table.count() <= most else table


def read_if_there(spark: SparkSession, path: str, schema=None) -> DataFrame | None:
    """The Parquet table at a path, or None where nothing has been written yet."""
    try:
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def latest_wins(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Of the rows of a key the one with the greatest `seq`."""
    order = Window.partitionBy(*keys).orderBy(F.desc(seq))
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", seq)


def upsert(path: str, incoming: DataFrame, keys: list[str], part: str, by: str | None = None) -> DataFrame:
    """Insert or overwrite rows of a Parquet table partitioned by `part`, a function of the keys.

    Of rows of one key the one with the greatest `by` wins, without `by` the incoming one (of several incoming
    rows any, then). Only partitions that the incoming rows touch are read and written again (dynamic
    partition overwrite), so a run that is repeated leaves the table as it is.
    """
    spark = incoming.sparkSession
    rank = (lambda k: F.struct(F.col(by), F.lit(k))) if by else F.lit
    seq = incoming.withColumn("_seq", rank(1))
    old = read_if_there(spark, path)
    if old is not None:
        touched = F.broadcast(incoming.select(part).distinct())  # partition names: few by design
        seq = old.join(touched, part, "left_semi").withColumn("_seq", rank(0)).unionByName(seq)
    merged = latest_wins(seq, keys, "_seq")
    staged = scratch(spark, "stage")  # a table cannot be overwritten while it is read
    merged.write.parquet(staged)
    spark.read.parquet(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)
    return spark.read.parquet(path)


def replace_children(old: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """All children of the parents in `new` are replaced by those in `new`."""
    return old.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)
