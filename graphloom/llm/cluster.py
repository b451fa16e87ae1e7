"""Written tables in the shared folder, and connected components over them."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.sources.tables import scratch_dir

_written: list[tuple[SparkSession, str]] = []


def written(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """df written once as Parquet and read again: lineage ends there, and a lost executor loses nothing of it."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/graphloom-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    if not _written:
        atexit.register(_drop_all)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._graphloom_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete what written() made, once nothing reads it any more."""
    path = getattr(df, "_graphloom_path", None)
    for item in [x for x in _written if x[1] == path]:
        _written.remove(item)
        _delete(*item)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _drop_all() -> None:
    for spark, path in _written:
        try:
            if spark._sc._jsc is not None:
                _delete(spark, path)
        except Exception:  # the session has ended; its folder goes with the cluster
            return


def fresh(name: str, taken: list[str]) -> str:
    """name, or name with underscores before it until no column has it."""
    while name.lower() in {x.lower() for x in taken}:
        name = f"_{name}"
    return name


#: Edges of a node from which on it can be hot, and the parts that its edges are dealt into.
HOT = 500
SALTS = 32


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of edges(a, b); root is the smallest node that links reach.

    Alternates large-star and small-star until no edge changes, which takes about the logarithm of the longest
    chain. The edges of a hot node are dealt into SALTS parts by their other end, and its minimum is pre-aggregated
    before the shuffle, so that no task holds them all. Null ends, self-links and repeated edges are ignored
    (a node with self-links only has a row with itself as root). An empty table gives an empty one.
    """
    kind = edges.schema[edges.columns[0]].dataType
    a, b = edges.columns[:2]
    raw = edges.select(F.col(a).alias("a"), F.col(b).cast(kind).alias("b")).where("a is not null and b is not null")
    every = raw.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = written(every)
    first = now
    stamp = None
    for _ in range(max_rounds):
        # large star: every larger neighbour of a node goes to the smallest node of its neighbourhood
        both = now.where("u <> v").select("u", "v").union(now.where("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"))
        # nodes with a five-hundredth of all ends or more, so fewer than 500: their edges are dealt by the other end
        edges_now = low.agg(F.sum("n").alias("n")).first().n or 0
        hot = low.where(F.col("n") > F.lit(max(HOT, edges_now // 500))).select("u", F.lit(SALTS).alias("salts"))
        salted = both.join(F.broadcast(hot), "u", "left").withColumn("salt", F.when(F.col("salts").isNotNull(), F.pmod(F.xxhash64("v"), "salts").cast("int")).otherwise(0)).drop("salts")
        copies = low.join(F.broadcast(hot), "u", "left").select("u", "m", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
        large = salted.join(copies, ["u", "salt"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: every smaller neighbour, and the node itself, goes to the smallest of them
        mins = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(mins, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        after = written(small)
        drop(low)
        mark = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now is not first:
            drop(now)
        now = after
        if mark == stamp:
            break
        stamp = mark
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = first.select("u").union(first.select("v")).distinct()
    return nodes.join(now, "u", "left").select(F.col("u").alias("node"), F.coalesce("v", "u").alias("root"))
