"""Statistics of types, calls, and evaluations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def type_counts(nodes: DataFrame) -> DataFrame:
    """(dim1, dim2, n, level): counts by dim1, by dim2, by both, and of all; level tells which."""
    grouped = nodes.select("dim1", "dim2").groupingSets([[F.col("dim1")], [F.col("dim2")], [F.col("dim1"), F.col("dim2")], []], "dim1", "dim2").agg(F.count("*").alias("n"), F.grouping_id().cast("bigint").alias("level"))
    return grouped


def first_of_each_type(nodes: DataFrame, limit: int) -> DataFrame:
    """Up to limit nodes of each (dim1, dim2), the smaller ids first."""
    rank = F.row_number().over(Window.partitionBy("dim1", "dim2").orderBy("entity_id")).cast("bigint")
    return nodes.select("dim1", "dim2", "entity_id").withColumn("rank", rank).where(F.col("rank") <= limit)


def usage(calls: DataFrame) -> DataFrame:
    """(model, caller, level, calls, tokens, average) of calls(model, caller, tokens): by model, by caller, and in all."""
    return calls.groupingSets([[F.col("model")], [F.col("caller")], []], "model", "caller").agg(
        F.grouping_id().cast("bigint").alias("level"), F.count("*").alias("calls"), F.round(F.sum("tokens"), 4).alias("tokens"), F.round(F.avg("tokens"), 6).alias("average")
    )


def _valid(column: str):
    return F.when(~F.isnan(column), F.col(column))


def case_scores(cases: DataFrame, metrics: list[str], key: str) -> DataFrame:
    """(key, score): the mean of a case's metrics that aren't NaN; null if all are."""
    values = F.filter(F.array(*[F.col(m) for m in metrics]), lambda x: x.isNotNull() & ~F.isnan(x))
    return cases.select(key, F.round(F.try_divide(F.aggregate(values, F.lit(0.0), lambda s, x: s + x), F.size(values)), 6).alias("score"))


def benchmark_stats(cases: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, mean, low, high, n, success_percent) over the cases, NaN left out; rounded to 4."""
    each = cases.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), _valid(m).alias("v")) for m in metrics])).alias("e"))
    return each.select("e.metric", "e.v").groupBy("metric").agg(
        F.round(F.avg("v"), 4).alias("mean"), F.round(F.min("v"), 4).alias("low"), F.round(F.max("v"), 4).alias("high"), F.count("v").alias("n"),
        F.round(F.count("v") * 100.0 / F.count("*"), 2).alias("success_percent"),
    )


def histogram(edges: DataFrame) -> DataFrame:
    """(bucket, n) of weights: up to 1, 2, 3, and above."""
    bucket = F.when(F.col("weight") <= 1, "0-1").when(F.col("weight") <= 2, "1-2").when(F.col("weight") <= 3, "2-3").otherwise("3+")
    return edges.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def coverage(rows: DataFrame, column: str) -> DataFrame:
    return rows.agg(F.count(column).alias("present"), F.count("*").alias("total"), F.round(F.count(column) / F.count("*"), 6).alias("share"))


def merge_savings(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, n_before, n_after, saved_percent): rows of a block before and after merging, 0 percent of nothing."""
    both = before.groupBy(key).agg(F.count("*").alias("n_before")).join(after.groupBy(key).agg(F.count("*").alias("n_after")), key, "full_outer")
    filled = both.select(key, F.coalesce("n_before", F.lit(0)).alias("n_before"), F.coalesce("n_after", F.lit(0)).alias("n_after"))
    share = F.when(F.col("n_before") > 0, F.round((F.col("n_before") - F.col("n_after")) * 100.0 / F.col("n_before"), 4)).otherwise(F.lit(0.0))
    return filled.withColumn("saved_percent", share)


def scaled(rows: DataFrame, column: str, low: float = 0.5, high: float = 2.0) -> DataFrame:
    """rows with a column scaled between low and high by its least and largest value; low where they are equal."""
    ends = rows.agg(F.min(column).alias("\x01a"), F.max(column).alias("\x01b"))
    at = F.try_divide(F.col(column) - F.col("\x01a"), F.col("\x01b") - F.col("\x01a"))
    return rows.crossJoin(F.broadcast(ends)).withColumn("scaled", F.round(F.coalesce(F.lit(low) + at * (high - low), F.lit(low)), 6)).drop("\x01a", "\x01b")
