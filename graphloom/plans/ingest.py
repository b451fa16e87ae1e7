"""From documents to a merged graph: chunks, extraction by a model, document-level merging, alignment, aggregation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import hashed_id
from graphloom.operators import extract, merge
from graphloom.operators.hooks import Model, call_with_cache
from graphloom.schema import SEP, UNKNOWN
from graphloom.sources.tables import materialized


@dataclass(frozen=True)
class Extraction:
    chunks: DataFrame
    entities: DataFrame
    relations: DataFrame
    cache: DataFrame


def extract_graph(docs: DataFrame, model: Model, cache: DataFrame | None = None, size: int = 1200, overlap: int = 100, instructions: str = "") -> Extraction:
    """documents(text) to chunks, entities and relations, with the answers that are new to the cache(key, response)."""
    spark = docs.sparkSession
    rows = docs.select(F.trim("text").alias("text")).where("text <> ''").withColumn("file_path", hashed_id("doc-", F.col("text")))
    first = rows.dropDuplicates(["file_path"])
    windows = extract.token_windows(first, size, overlap, "file_path", "text").withColumnRenamed("doc_id", "file_path")
    prompts = windows.withColumn("prompt", F.concat(F.lit(instructions), F.col("content")))
    known = cache if cache is not None else spark.createDataFrame([], "key string, response string")
    answered, fresh = call_with_cache(prompts, "prompt", known, model)
    answered = materialized(answered.select("file_path", "chunk_id", "chunk_order_index", "tokens", "content", "response"))
    responses = answered.select(F.col("file_path").alias("doc_id"), F.col("chunk_order_index").alias("pos"), "file_path", "chunk_id", F.coalesce("response", F.lit("")).alias("response"))
    entities = extract.merge_same_names(extract.entities(responses), "file_path")
    resolved, relations = extract.resolve_relations(extract.relations(responses), entities)
    return Extraction(answered.drop("response"), resolved, relations, fresh)


def merge_graph(entities: DataFrame, relations: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities(entity_id, pos, dim1, dim2, description, source_id) that share a root(id, root) as one, and relations between
    what is left, one for each pair; roots are positions."""
    grouped = entities.join(roots, F.col("pos") == F.col("id"))
    merged = merge.merge_groups(grouped, "root", "pos").drop("root")
    ids = merge.mapping(merged)
    moved = merge.rewrite_ends(relations, ids, merged)
    return merged, merge.merge_relations(moved)


def insert_custom(chunks: DataFrame, entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A hand-made graph: chunks(content, source_id), entities(entity_name, source_id, ...), relations(src_id, tgt_id, source_id, ...);
    source ids become chunk ids, UNKNOWN where there is no such chunk, and missing ends become entities of unknown type."""
    stored = chunks.withColumn("chunk_id", hashed_id("chunk-", F.trim("content")))
    ids = stored.groupBy("source_id").agg(F.min("chunk_id").alias("chunk_id"))
    linked = lambda df: df.join(ids, "source_id", "left").withColumn("chunk_id", F.coalesce("chunk_id", F.lit(UNKNOWN))).drop("source_id")
    nodes = linked(entities).withColumnRenamed("entity_name", "entity_id")
    edges = linked(relations)
    missing = merge.missing_ends(edges, nodes)
    everything = nodes.unionByName(missing.select("entity_id", F.col("entity_type").alias("dim1"), F.lit(UNKNOWN).alias("chunk_id")), allowMissingColumns=True)
    return stored, everything, edges


def rebuild(records: DataFrame, surviving: DataFrame) -> DataFrame:
    """Entities of extraction records(chunk_id, name, dim1, description, pos) from surviving(chunk_id) alone."""
    left = records.join(surviving, "chunk_id", "left_semi")
    return left.groupBy("name").agg(F.array_join(F.array_distinct(extract.ordered("description", "pos")), SEP).alias("description"), F.array_join(F.array_distinct(extract.ordered("chunk_id", "pos")), SEP).alias("source_id"))
