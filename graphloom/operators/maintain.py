"""Documents, their status, and what goes when a document goes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.lists import subtract
from graphloom.functions.text import hashed_id, pair_key, split_markers, summary
from graphloom.operators.extract import keep_first, ordered
from graphloom.schema import DOC_STATUSES, SEP
from graphloom.sources.tables import materialized


def enqueue(docs: DataFrame, existing: DataFrame, order: str = "doc_id") -> DataFrame:
    """(id, content_summary, content_length, status) of new contents: trimmed, empty ones dropped, of equal ones the first, and none whose id existing(id) has."""
    rows = docs.select(F.col(order).alias("pos"), F.trim("text").alias("content")).where("content <> ''").withColumn("id", hashed_id("doc-", F.col("content")))
    first = keep_first(rows, ["id"], ["pos"])
    return first.join(existing.select("id"), "id", "left_anti").select("id", "pos", summary(F.col("content")).alias("content_summary"), F.char_length("content").cast("bigint").alias("content_length"), F.lit("pending").alias("status"))


def status_counts(rows: DataFrame, statuses: tuple[str, ...] = DOC_STATUSES) -> DataFrame:
    """(status, n) for every status, 0 where there is none, and their sum as 'all'."""
    every = rows.sparkSession.createDataFrame([(s,) for s in statuses], "status string")
    counted = every.join(rows.groupBy("status").agg(F.count("*").alias("c")), "status", "left").select("status", F.coalesce("c", F.lit(0)).cast("bigint").alias("n"))
    return counted.union(counted.agg(F.lit("all").alias("status"), F.sum("n").alias("n")))


def page(rows: DataFrame, number: int, size: int, by: str, tie: str, descending: bool = True) -> DataFrame:
    """One page of a sorted listing, with total; sizes are held to 10..200 and pages start at 1."""
    size, number = min(max(size, 10), 200), max(number, 1)
    total = rows.agg(F.count("*").alias("total"))
    order = [F.desc(by), tie] if descending else [by, tie]
    return rows.orderBy(*order).offset((number - 1) * size).limit(size).crossJoin(F.broadcast(total))


def move(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """Status rows(id, status, updated_at) with the latest change of each id applied."""
    every = rows.unionByName(changes)
    return every.withColumn("\x01n", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("updated_at"), F.desc("status")))).where("`\x01n` = 1").drop("\x01n")


def deletion_impact(records: DataFrame, doc_chunks: DataFrame) -> DataFrame:
    """(key, remaining, left, action) of records(key, chunk_ids) that name any of doc_chunks(chunk_id): what is left of their chunks,
    as a list for reading and as an array, and whether they are deleted or rebuilt."""
    named = records.select("key", F.explode("chunk_ids").alias("chunk_id")).join(doc_chunks.select("chunk_id"), "chunk_id").groupBy("key").agg(F.collect_set("chunk_id").alias("gone"))
    hit = records.join(named, "key").withColumn("left", subtract(F.col("chunk_ids"), F.col("gone")))
    return hit.select("key", F.array_join("left", ",").alias("remaining"), "left", F.when(F.size("left") == 0, "delete").otherwise("rebuild").alias("action"))


def deletion_impact_of(named: DataFrame, doc_chunks: DataFrame) -> DataFrame:
    """deletion_impact() of rows named(key, chunk_id), in one pass over them; chunks in order of their ids."""
    gone = materialized(doc_chunks.select(F.col("chunk_id").alias("\x01gone")).distinct())
    marked = named.join(gone, F.col("chunk_id") == F.col("\x01gone"), "left")
    lists = marked.groupBy("key").agg(F.count("\x01gone").alias("hits"), F.collect_set(F.when(F.col("\x01gone").isNull(), F.col("chunk_id"))).alias("ids")).where("hits > 0")
    both = lists.select("key", F.sort_array("ids").alias("left"))
    return both.select("key", F.array_join("left", ",").alias("remaining"), "left", F.when(F.size("left") == 0, "delete").otherwise("rebuild").alias("action"))


def delete_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without gone(entity_id) and whatever touches it."""
    ids = gone.select("entity_id")
    return nodes.join(ids, "entity_id", "left_anti"), edges.join(ids, F.col("src_id") == F.col("entity_id"), "left_anti").join(ids, F.col("tgt_id") == F.col("entity_id"), "left_anti")


def rename(nodes: DataFrame, edges: DataFrame, old: str, new: str) -> tuple[DataFrame, DataFrame]:
    """A node under a new id; its edges follow. The new id must be free."""
    if nodes.where(F.col("entity_id") == new).limit(1).count():
        raise ValueError(f"{new!r} exists")
    swap = lambda c: F.when(F.col(c) == old, F.lit(new)).otherwise(F.col(c)).alias(c)
    keep = lambda df, *cs: df.select(*[swap(c) if c in cs else F.col(c) for c in df.columns])
    return keep(nodes, "entity_id"), keep(edges, "src_id", "tgt_id")


def lineage(records: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc_id, names, n): what names records(key, chunk_ids) have in each document of chunks(chunk_id, doc_id)."""
    return lineage_of(records.select("key", F.explode("chunk_ids").alias("chunk_id")), chunks)


def lineage_of(named: DataFrame, chunks: DataFrame) -> DataFrame:
    """lineage() of rows named(key, chunk_id), where a key's chunks are too many to be gathered."""
    each = named.join(chunks, "chunk_id").select("doc_id", "key").distinct()
    return each.groupBy("doc_id").agg(F.sort_array(F.collect_set("key")).alias("keys")).select("doc_id", F.array_join("keys", ",").alias("names"), F.size("keys").cast("bigint").alias("n"))


def chunk_tracking(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, key, chunk_ids, n): the chunks of each node and each pair from their source_id, blanks dropped, repeats kept once.
    Records without any have no row; of a pair's edges all count, in the order of their ids."""
    named = nodes.select(F.lit("entity").alias("kind"), F.col("entity_id").alias("key"), F.lit("").alias("edge_id"), "source_id")
    paired = edges.select(F.lit("relation").alias("kind"), pair_key(F.col("src_id"), F.col("tgt_id")).alias("key"), "edge_id", "source_id")
    # dealt by key once, before rows are multiplied; both groupings then need no other shuffle
    dealt = named.union(paired).repartition("kind", "key")
    each = dealt.select("kind", "key", "edge_id", F.posexplode(split_markers(F.col("source_id"), SEP)).alias("i", "chunk_id"))
    once = each.groupBy("kind", "key", "chunk_id").agg(F.min(F.struct("edge_id", "i")).alias("first"))
    lists = once.groupBy("kind", "key").agg(ordered("chunk_id", "first").alias("chunk_ids"))
    return lists.withColumn("n", F.size("chunk_ids").cast("bigint"))


def cached_results(chunks: DataFrame, cache: DataFrame, kind: str = "extract") -> DataFrame:
    """(chunk_id, place, key, response): stored answers of a kind that chunks(chunk_id, llm_cache_list) name, of cache(key, cache_type,
    response, created_at), the oldest first. Keys that the cache lacks are left out."""
    named = chunks.select("chunk_id", F.explode(F.array_distinct("llm_cache_list")).alias("key"))
    rows = named.join(cache.where(F.col("cache_type") == kind), "key")
    place = F.row_number().over(Window.partitionBy("chunk_id").orderBy("created_at", "key")).cast("bigint")
    return rows.select("chunk_id", place.alias("place"), "key", "response")


def delete_relations(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Edges without those between pairs(src_id, tgt_id), either way round."""
    both = pairs.select("src_id", "tgt_id").union(pairs.select("tgt_id", "src_id")).distinct()
    return edges.join(both, ["src_id", "tgt_id"], "left_anti").select(*edges.columns)
