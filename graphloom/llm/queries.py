"""The registered queries of this package: thin forms of its operators over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import decontaminate, html_text, licenses, mixing, ngram_join, oracles, pii, quality_classifier, quality_rules, suffix_dedup, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality_classifier.classify(docs, table(spark, sf_dir, "labels"), keep=["doc_id"])
    return scored.select("doc_id", quality_classifier.held_out("doc_id").alias("held_out"), "score", "predicted")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.apply_policy(quality_rules.ledger(table(spark, sf_dir, "documents"), keep=["doc_id"]))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicate(table(spark, sf_dir, "documents")).drop("kept")


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).drop("text", "hit_spans")


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])


def document_path() -> F.Column:
    """Documents have no paths: source/language/id stands for one."""
    return F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents").withColumn("path", document_path()))
    return found.withColumnRenamed("file_id", "doc_id")


def document_tree_path() -> F.Column:
    """Stands for a path in a tree with licence files: of ten ids one is a licence file of its source, one of its source and language."""
    number = F.col("doc_id").cast("string")
    folder = F.when(F.coalesce(F.col("doc_id") % 10, F.lit(1)) != 0, F.col("lang"))
    return F.concat_ws("/", "source", folder, F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("LICENSE."), number)).otherwise(F.concat(number, F.lit(".txt"))))


def op10_license_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan where licence files speak for their directories, which no path of document_path does."""
    found = licenses.scan(table(spark, sf_dir, "documents").withColumn("path", document_tree_path()))
    return found.withColumnRenamed("file_id", "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for name, fn in globals().items() if name.startswith("op") and callable(fn)}


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filter": oracles.op2(), "op3_ngram_join": oracles.op3(), "op4_quality_rules": oracles.op4(), "op7_decontamination": oracles.op7(), "op10_license_scan": oracles.op10(), "op10_license_tree": oracles.op10_tree()}
