"""Mixing sources to target weights by capped water-filling, with DataFrame operations only.

Sources in order of code points (null last) take the weights of a pattern that repeats. They share budget_percent of
all words by weight; a target stops at max_epochs times its source's size and what is above is shared among the
others by weight again, until none is above. That end state is a water level: with sources in order of cap / weight,
the clamped ones are a prefix, found by running sums, so that no loop is needed.

The mix takes every document of a source floor(target / size) times, and the documents of the fractional repetition
once more: those whose middle lies below the fraction when a source's documents stand in seeded order. Documents
are dealt into BUCKETS ranges of the seeded hash; sums by (source, bucket) place each bucket, and a running sum
within a bucket places its documents. So no task holds a source, however hot: a bucket of one that has a third of all
rows has a 12,000th of them.

Size is the number of words `[^\\x20\\x09-\\x0D]+` (null or empty text: 0). Documents of size 0 take nothing and a
source of size 0 has target 0. Null ids and repeated rows are documents like others; equal rows can differ in what they take only at
the boundary of the fraction. An empty table gives an empty mix. Extra columns don't matter: they are kept by mix(),
but for those with the name of one of its columns, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.cluster import written

WEIGHTS = (5, 2, 1)
BUDGET_PERCENT = 150
MAX_EPOCHS = 2
BUCKETS = 4096


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget_percent: int = BUDGET_PERCENT, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size): one row for each source.

    The windows without a partition run over one row for each source, not over documents.
    """
    order = Window.orderBy(F.col("source").cast("binary").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weighed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    capped = weighed.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").cast("binary").asc_nulls_last())
    before, after = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    budget = F.sum("source_size").over(Window.partitionBy()) * F.lit(budget_percent / 100.0)
    level = (budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    tried = capped.withColumn("level", level)
    # the first source that its level doesn't clamp fixes the level of all after it
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    water = F.first(fits, ignorenulls=True).over(by_level.rowsBetween(Window.unboundedPreceding, 0))
    return tried.withColumn("water", water).select("source", "source_size", "weight", F.when(F.col("water").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("water") * F.col("weight"))).alias("target"))


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", keep: list[str] = (), weights: tuple[int, ...] = WEIGHTS, budget_percent: int = BUDGET_PERCENT, max_epochs: int = MAX_EPOCHS, seed: int = 42, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, size, source_size, target, copies (times that the mix takes the document), taken (words) and the kept columns."""
    key = F.xxhash64(F.lit(seed), F.col(f"`{doc_id}`").cast("string"), F.xxhash64(F.col(f"`{text}`")))
    own = ["doc_id", "source", "size", "source_size", "target", "copies", "taken"]
    rest = [c for c in keep if c.lower() not in own]
    rows = written(
        docs.select(
            F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").cast("string").alias("source"), word_count(F.col(f"`{text}`")).alias("size"), key.alias("\x01key"),
            F.pmod(F.shiftright(key, 20), F.lit(buckets)).cast("int").alias("\x01bucket"), *[F.col(f"`{c}`") for c in rest],
        )
    )
    in_bucket = rows.groupBy("source", "\x01bucket").agg(F.sum("size").alias("bucket_size"))
    per_source = in_bucket.groupBy("source").agg(F.sum("bucket_size").alias("source_size"))
    aims = targets(per_source, weights, budget_percent, max_epochs)
    up_to = Window.partitionBy("source").orderBy("\x01bucket").rowsBetween(Window.unboundedPreceding, -1)
    placed = in_bucket.withColumn("before", F.coalesce(F.sum("bucket_size").over(up_to), F.lit(0))).join(aims.withColumnRenamed("source", "\x01s"), F.col("source").eqNullSafe(F.col("\x01s")))
    ratio = F.coalesce(F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size")), F.lit(0.0))
    plan = placed.select(F.col("source").alias("\x01s"), F.col("\x01bucket").alias("\x01b"), "before", "source_size", "target", F.floor(ratio).alias("whole"), ((ratio - F.floor(ratio)) * F.col("source_size")).alias("cut"))
    both = rows.join(plan, F.col("source").eqNullSafe(F.col("\x01s")) & (F.col("\x01bucket") == F.col("\x01b")))
    inner = Window.partitionBy("source", "\x01bucket").orderBy("\x01key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    middle = F.col("before") + F.sum("size").over(inner) - F.col("size") / 2
    copies = (F.col("whole") + F.when(middle < F.col("cut"), 1).otherwise(0)).cast("bigint")
    return both.withColumn("copies", copies).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *[F.col(f"`{c}`") for c in rest])
