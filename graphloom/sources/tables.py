"""Tables as Parquet snapshots: cutting lineage, upserts, look-ups, deletions."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder in spark.checkpoint.dir; one of our own only where none is set, on one machine."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("graphloom.own.dir", None)
    if not at and not spark.sparkContext.master.startswith("local"):
        # executors would each write to a disk of their own, and rows would be lost in silence
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not at:
        at = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("graphloom.own.dir", at)
    return at


def materialized(df: DataFrame) -> DataFrame:
    """df written once to the shared folder and read again, so that what follows doesn't compute it anew and survives lost executors."""
    path = f"{scratch_dir(df.sparkSession)}/graphloom-table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(rows: DataFrame, *keys: str, each: int = 250_000) -> DataFrame:
    """rows dealt by keys over as many tasks as run at once, more where a task would get over each rows. For rows that are small here
    and grow later: Spark joins shuffled tasks by their bytes, so that few of them do all the work, each with a large table in memory."""
    n = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // each))
    return rows.repartition(n, *keys)


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """The rows of new over those of existing with the same key; rows with a null key are dropped. Of several new rows of a key
    the last in order wins."""
    rank = [F.col(c).desc() for c in order or []]
    rows = existing.withColumn("\x01age", F.lit(1)).unionByName(new.withColumn("\x01age", F.lit(0)))
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    first = Window.partitionBy(*keys).orderBy("\x01age", *rank)
    return rows.withColumn("\x01n", F.row_number().over(first)).where("`\x01n` = 1").drop("\x01n", "\x01age")


def append_new(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """existing, and the rows of new whose key it lacks."""
    return existing.unionByName(new.join(existing.select(*keys), keys, "left_anti"))


def new_keys(wanted: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    return wanted.select(key).distinct().join(stored.select(key), key, "left_anti")


def get_many(table: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """wanted(pos, key) in order with the columns of the table, null where it has none."""
    return wanted.join(table, key, "left")


def delete_keys(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return table.join(gone.select(key), key, "left_anti")
