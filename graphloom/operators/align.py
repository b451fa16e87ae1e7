"""Alignment of entities within blocks: names, problem ids, similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import base_name, is_problem_type, problem_id
from graphloom.operators.graph import roots
from graphloom.operators.vector import CHUNK, best_of_cell, pieces_of_blocks
from graphloom.shipping import ship


def best_earlier(vectors: DataFrame, threshold: float | None, chunk: int = CHUNK, strict: bool = True) -> DataFrame:
    """(node, parent, score): for each row(id, block, embedding) the most similar row of its block with a smaller id.

    Pieces as in the nearest-neighbour search; of a product only the columns that hold an earlier row are made."""
    ship(vectors.sparkSession)
    kind = vectors.schema["id"].dataType.simpleString()
    found = pieces_of_blocks(vectors).groupBy("block", "i", "j").applyInPandas(lambda pdf: best_of_cell(pdf, 1, chunk, earlier=True), f"src {kind}, tgt {kind}, score double")
    cells = found.toDF("node", "parent", "score")
    one = cells.groupBy("node").agg(F.min(F.struct((-F.col("score")).alias("minus"), "parent")).alias("b"))
    out = one.select("node", F.col("b.parent").alias("parent"), (-F.col("b.minus")).alias("score"))
    if threshold is None:
        return out
    return out.where(F.col("score") > threshold if strict else F.col("score") >= threshold)


def align_by_threshold(vectors: DataFrame, threshold: float = 0.8, chunk: int = CHUNK) -> DataFrame:
    """(id, root): rows that follow their best earlier row beyond the threshold, chains followed to their start."""
    found = best_earlier(vectors, threshold, chunk).select("node", "parent")
    linked = roots(found)
    return vectors.select("id").join(linked, F.col("id") == F.col("node"), "left").select("id", F.coalesce("root", "id").alias("root"))


def align_by_rules(entities: DataFrame) -> DataFrame:
    """(pos, root, rule) for entities(pos, block, entity_id, dim2): equal names of a block follow the first of them; problems follow
    the first of their problem id instead, and one without a valid id stays alone."""
    named = entities.withColumns({"problem": is_problem_type(F.col("dim2")), "name": base_name(F.col("entity_id"))}).withColumn("pid", problem_id(F.col("entity_id")))
    by_name = F.min("pos").over(Window.partitionBy("block", "problem", "name"))
    by_problem = F.min("pos").over(Window.partitionBy("block", "problem", "pid"))
    root = F.when(~F.col("problem"), by_name).when(F.col("pid").isNotNull(), by_problem).otherwise(F.col("pos"))
    rule = F.when(F.col("root") == F.col("pos"), "first").when(F.col("problem"), "problem id").otherwise("name")
    return named.withColumn("root", root).select("pos", "root", rule.alias("rule"))


def align(entities: DataFrame, vectors: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(id, root): rules first; what they leave to itself and isn't a problem follows its best earlier row of similarity at least the threshold."""
    ruled = align_by_rules(entities).select(F.col("pos").alias("id"), F.col("root").alias("ruled"))
    alone = entities.where(~is_problem_type(F.col("dim2"))).select(F.col("pos").alias("id")).join(ruled.where("id = ruled"), "id", "left_semi")
    near = best_earlier(vectors.join(alone, "id", "left_semi"), threshold, strict=False).select("node", "parent")
    pointers = ruled.where("id <> ruled").select(F.col("id").alias("node"), F.col("ruled").alias("parent")).union(near)
    linked = roots(pointers)
    return ruled.select("id").join(linked, F.col("id") == F.col("node"), "left").select("id", F.coalesce("root", "id").alias("root"))


