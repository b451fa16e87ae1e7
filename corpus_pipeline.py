"""From documents to a training mix: five stages, each over all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import decontaminate, mixing, ngram_join, pii, quality_classifier
from graphloom.llm.cluster import fresh, written


def _wrapped(docs: DataFrame, *names: str) -> DataFrame:
    """The whole row as one column beside those that an operator reads, so that no name clashes."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *names)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    # by place, so that no name clashes with a result's and a text goes to Python once
    names = [c if c in ("doc_id", "text") else f"c{k}" for k, c in enumerate(docs.columns)]
    scored = quality_classifier.classify(docs.toDF(*names), labels, keep=names)
    return scored.where("predicted = 1").select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays; documents link from a Jaccard similarity of 0.8 of five-word shingles on."""
    return ngram_join.one_of_each(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return decontaminate.without_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind; n_chars follows the text."""
    done = pii.redact(docs)
    return done.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document: the columns of documents, size, target, copies and copy."""
    mixed = mixing.mix(_wrapped(docs, "doc_id", "text", "source"), keep=["row"])
    each = F.explode(F.sequence(F.lit(1).cast("bigint"), "copies"))
    named = [F.col(c).alias(fresh(c, docs.columns)) for c in ("size", "target", "copies")]
    return mixed.where("copies > 0").select("row.*", *named, each.alias(fresh("copy", docs.columns)))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
]

#: A trained classifier and a trained field aren't SQL. Tests hold what each stage keeps against its operator, and the operators against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
