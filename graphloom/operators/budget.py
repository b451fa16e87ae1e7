"""Ranked lists under budgets: truncation, interleaving, quotas, references."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def within_budget(rows: DataFrame, tokens: str, budget: int, order: list[str], partition: list[str] = ()) -> DataFrame:
    """The longest prefix in order whose tokens sum to the budget at most, with used (the running sum); none for a budget of 0 or less."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(tokens).over(w)).where((F.col("used") <= budget) & F.lit(budget > 0))


def interleave(lists: list[DataFrame], key: str, rank: str = "rank") -> DataFrame:
    """(key, source, rank, place): one of each list in turn, the first of equal keys staying."""
    rows = None
    for i, one in enumerate(lists):
        part = one.select(key, F.lit(i).cast("bigint").alias("source"), F.col(rank).cast("bigint").alias("rank"))
        rows = part if rows is None else rows.union(part)
    first = rows.groupBy(key).agg(F.min(F.struct("rank", "source")).alias("f")).select(key, "f.source", "f.rank")
    return first.withColumn("place", F.row_number().over(Window.orderBy("rank", "source")).cast("bigint"))


def quotas(owners: DataFrame, most: int, least: int = 1) -> DataFrame:
    """(owner, pos, base, taken) of owners(owner, size, pos): quotas fall evenly (half to even) from most to least with the
    position, and quotas that an owner can't use go to the first owners with more. base is what its own quota gives it.
    The windows without a partition run over one row for each owner."""
    n = F.count("*").over(Window.partitionBy())
    quota = F.when(n == 1, F.lit(most)).otherwise(F.bround(F.lit(float(most)) - (F.col("pos") - 1) / (n - 1) * F.lit(float(most - least)), 0)).cast("bigint")
    rows = owners.withColumn("quota", quota)
    rows = rows.withColumns({"base": F.least("quota", "size"), "spare": F.greatest(F.col("size") - F.col("quota"), F.lit(0)), "unused": F.greatest(F.col("quota") - F.col("size"), F.lit(0))})
    total = F.sum("unused").over(Window.partitionBy())
    before = F.coalesce(F.sum("spare").over(Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    more = F.when(n == 1, F.lit(0)).otherwise(F.greatest(F.lit(0), F.least(F.col("spare"), total - before)))
    return rows.select("owner", "pos", F.col("base").cast("int").alias("base"), (F.col("base") + more).cast("int").alias("taken"))


def weighted_polling(owners: DataFrame, most: int, least: int = 1) -> DataFrame:
    """(owner, pos, i, chunk) picked from owners(owner, pos, chunks): each takes as many of its chunks, in order, as quotas() gives the
    owners by their positions. For lists as retrieval has them; owners with many chunks: polling_by_size()."""
    places = owners.select("owner", F.coalesce(F.size("chunks"), F.lit(0)).cast("bigint").alias("size"), F.row_number().over(Window.orderBy("pos")).cast("bigint").alias("pos"))
    picked = owners.select("owner", "chunks").join(quotas(places, most, least).where("taken > 0"), "owner")
    return picked.select("owner", "pos", F.posexplode(F.expr("slice(chunks, 1, taken)")).alias("i", "chunk"))


def polling_by_size(chunks: DataFrame, most: int, least: int = 1, salts: int = 64) -> DataFrame:
    """(owner, pos, i, chunk) picked from chunks(owner, chunk): owners stand by how many chunks they have and take as many as
    quotas() gives them, in the order of the chunks.

    Chunks of a hot owner are cut to its quota within salted parts before its ranks are made, so that no task holds an
    owner whole."""
    sizes = chunks.groupBy("owner").agg(F.count("*").alias("size"))
    owners = sizes.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("size"), "owner")).cast("bigint"))
    each = chunks.join(quotas(owners, most, least).drop("base"), "owner").withColumn("salt", F.pmod(F.xxhash64("chunk"), F.lit(salts)))
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("chunk"))
    few = each.withColumn("i", rank("owner", "salt")).where(F.col("i") <= F.col("taken"))
    return few.withColumn("i", rank("owner")).where(F.col("i") <= F.col("taken")).select("owner", "pos", (F.col("i") - 1).alias("i"), "chunk")


def by_occurrence(links: DataFrame) -> DataFrame:
    """(chunk, owner, n, first): chunks that links(owner, pos, chunk) name: the first owner keeps one, with how often it is named."""
    return links.groupBy("chunk").agg(F.count("*").alias("n"), F.min_by("owner", "pos").alias("owner"), F.min("pos").alias("first"))


def references(chunks: DataFrame, path: str = "file_path", order: str = "pos") -> DataFrame:
    """(reference_id, file_path, n): files by how often they are named, of equal ones the one met first; unknown_source isn't one."""
    counted = chunks.where((F.col(path) != "unknown_source") & (F.col(path) != "")).groupBy(F.col(path).alias("file_path")).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counted.select(F.row_number().over(Window.orderBy(F.desc("n"), "first")).cast("string").alias("reference_id"), "file_path", "n")


def pack(parts: list[tuple[int, str]], limit: int, least: int = 2) -> list[list[str]]:
    """Consecutive (tokens, text) in groups of at most limit tokens, but of least parts: the greedy packing of a summary's map step."""
    groups: list[list[str]] = []
    now: list[str] = []
    used = 0
    for tokens, text in parts:
        if now and used + tokens > limit and len(now) >= least:
            groups.append(now)
            now, used = [], 0
        now.append(text)
        used += tokens
    return [*groups, now] if now else groups
