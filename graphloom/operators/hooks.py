"""Hooks for models: language model calls with a cache and retries, and summaries of descriptions."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.text import cache_key
from graphloom.operators.budget import pack
from graphloom.operators.extract import ordered
from graphloom.schema import SEP
from graphloom.shipping import ship

Model = Callable[[str], str]


def prompt_key(mode: str, kind: str, prompt: Column) -> Column:
    return cache_key(F.lit(mode), F.lit(kind), F.md5(prompt))


def call(rows: DataFrame, prompt: str, model: Model, out: str = "response", retries: int = 3, wait: float = 0.5, retry_on: tuple[type[Exception], ...] = (TimeoutError, ConnectionError)) -> DataFrame:
    """rows with the model's answer to each prompt, by partition; errors that retrying may mend are tried again, and null is left after the last."""
    ship(rows.sparkSession)
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.StringType())])

    def one(text: str) -> str | None:
        for k in range(retries):
            try:
                return model(text)
            except retry_on:
                if k < retries - 1:
                    time.sleep(wait * 2**k)
        return None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pdf.assign(**{out: [None if t is None else one(t) for t in pdf[prompt]]})

    return rows.mapInPandas(run, schema)


def call_with_cache(rows: DataFrame, prompt: str, cache: DataFrame, model: Model, mode: str = "default", kind: str = "extract", **options) -> tuple[DataFrame, DataFrame]:
    """(rows with response, new cache entries): prompts that cache(key, response) holds aren't asked again, and equal prompts are asked once."""
    keyed = rows.withColumn("key", prompt_key(mode, kind, F.col(prompt)))
    asked = keyed.select("key", prompt).where(F.col(prompt).isNotNull()).dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")
    fresh = call(asked, prompt, model, **options).select("key", "response")
    known = cache.select("key", "response").union(fresh.where("response is not null"))
    return keyed.join(known, "key", "left").drop("key"), fresh


def glean(first: DataFrame, second: DataFrame) -> DataFrame:
    """Entities(chunk_id, name, dim1, dim2, description) of two extractions: of each name in a chunk the version with the longer description, the first of equally long ones."""
    rows = first.withColumn("round", F.lit(0)).unionByName(second.withColumn("round", F.lit(1)))
    # dealt first, so that rows are sorted once, and by a number before the names; an aggregate of texts sorts before and after it deals
    first = Window.partitionBy("\x01key", "chunk_id", "name").orderBy(F.desc(F.char_length("description")), "round")
    dealt = rows.select(F.xxhash64("chunk_id", "name").alias("\x01key"), "chunk_id", "name", "dim1", "dim2", "description", "round").repartition("\x01key", "chunk_id", "name")
    return dealt.withColumn("\x01n", F.row_number().over(first)).where("`\x01n` = 1").select("chunk_id", "name", "dim1", "dim2", "description", F.col("round").cast("bigint").alias("round"))


def summarize(rows: DataFrame, key: str, description: str, order: str, model: Model | None = None, most: int = 4, max_tokens: int = 12_000) -> DataFrame:
    """(key, description, parts, by_model): different descriptions of a key in order, joined up to most of them; more go to the
    model, in groups of max_tokens words that are reduced until one group is left. Without a model all are joined."""
    lists = rows.where(F.col(description).isNotNull() & (F.col(description) != "")).groupBy(key).agg(F.array_distinct(ordered(description, order)).alias("parts"))
    joined = F.array_join("parts", SEP)
    sized = lists.select(key, "parts", F.size("parts").cast("bigint").alias("n"), joined.alias("joined"))
    few = sized.where((F.col("n") <= most) | F.lit(model is None)).select(key, F.col("joined").alias("description"), F.col("n").alias("parts"), F.lit(False).alias("by_model"))
    if model is None:
        return few
    ship(rows.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            done = []
            for parts in pdf["parts"]:
                now = list(parts)
                while True:
                    groups = pack([(len(p.split()), p) for p in now], max_tokens)
                    now = [model(SEP.join(g)) for g in groups]
                    if len(now) <= 1:
                        break
                done.append(now[0] if now else "")
            yield pd.DataFrame({key: pdf[key], "description": done, "parts": pdf["n"], "by_model": True})

    many = sized.where(F.col("n") > most).select(key, "parts", "n")
    kind = rows.schema[key].dataType.simpleString()
    return few.union(many.mapInPandas(run, f"{key} {kind}, description string, parts bigint, by_model boolean"))


def rerank_by_model(hits: DataFrame, text: str, scorer: Callable[[list[str]], list[float]] | None, k: int, minimum: float = 0.0) -> DataFrame:
    """hits with rerank_score, best first, those below the minimum dropped; without a scorer hits as they are, each scored 1."""
    if scorer is None:
        return hits.withColumn("rerank_score", F.lit(1.0)).limit(k)
    ship(hits.sparkSession)
    schema = T.StructType([*hits.schema.fields, T.StructField("rerank_score", T.DoubleType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pdf.assign(rerank_score=[float(x) for x in scorer(pdf[text].fillna("").tolist())])

    return hits.mapInPandas(run, schema).where(F.col("rerank_score") >= minimum).orderBy(F.desc("rerank_score"), text).limit(k)
