"""Searches over vectors(id, block, embedding)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.vectors import cosine, literal
from graphloom.schema import COSINE_THRESHOLD
from graphloom.shipping import ship

CHUNK = 2048
#: Numbers in the vectors of a piece of a block (8 MB), and in a table of scores (16 MB).
PIECE, TILE = 1 << 20, 1 << 21


def top_k(vectors: DataFrame, query: list[float], k: int, threshold: float | None = COSINE_THRESHOLD, digits: int = 4) -> DataFrame:
    """(id, score, rank): the k nearest by cosine rounded to digits, of equal ones the smaller id; a score per row and a
    top-k per partition, so that only k rows of each are shuffled."""
    score = F.round(cosine(F.col("embedding"), literal(query)), digits)
    rows = vectors.select("*", score.alias("score")).where("score is not null")
    if threshold is not None:
        rows = rows.where(F.col("score") >= threshold)
    best = rows.drop("embedding").orderBy(F.desc("score"), "id").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")).cast("bigint"))


def pieces_of_blocks(vectors: DataFrame) -> DataFrame:
    """vectors(id, block, embedding) twice, as side 0 and 1, dealt over cells(block, i, j) in which each two rows of a block meet once.

    A piece of a block is as many rows as PIECE numbers hold, so that a cell is bounded, however large a block is. A row is copied once for
    each piece of its block, on each side: with the size of a piece, not of what is multiplied at once."""
    sized = vectors.groupBy("block").agg(F.greatest(F.ceil(F.count("*") * F.max(F.size("embedding")) / PIECE), F.lit(1)).cast("int").alias("pieces"))
    dealt = vectors.join(sized, "block").withColumn("own", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int"))
    others = F.sequence(F.lit(0), F.col("pieces") - 1)
    left = dealt.select("id", "block", "embedding", F.lit(0).alias("side"), F.col("own").alias("i"), F.explode(others).alias("j"))
    right = dealt.select("id", "block", "embedding", F.lit(1).alias("side"), F.explode(others).alias("i"), F.col("own").alias("j"))
    return left.union(right.select(*left.columns))


def unit_rows(embeddings: pd.Series) -> np.ndarray:
    m = np.stack([np.asarray(v, np.float64) for v in embeddings])
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def best_of_cell(pdf: pd.DataFrame, k: int, chunk: int, digits: int = 4, earlier: bool = False) -> pd.DataFrame:
    """(src, tgt, score): for each row of side 0 its k best of side 1 by rounded cosine, of equal ones the smaller id; earlier: of smaller ids only.

    At most chunk rows are multiplied at once, fewer where side 1 is long. Score and place of an id make one number, so that
    the best are picked, not sorted."""
    left, right = pdf[pdf["side"] == 0].sort_values("id"), pdf[pdf["side"] == 1].sort_values("id")
    none = pd.DataFrame({"src": pdf["id"][:0], "tgt": pdf["id"][:0], "score": np.empty(0)})
    if not len(left) or not len(right):
        return none
    a, b = left["id"].to_numpy(), right["id"].to_numpy()
    x, y = unit_rows(left["embedding"]), unit_rows(right["embedding"]).T.copy()
    low, high, scale = np.searchsorted(b, a, "left"), np.searchsorted(b, a, "right"), 10.0**digits
    width, step, found = len(b), max(1, min(chunk, TILE // len(b))), [none]
    place = np.arange(width - 1, -1, -1, dtype=np.float64)
    for at in range(0, len(a), step):
        to = min(at + step, len(a))
        n = int(low[to - 1]) if earlier else width
        if not n:
            continue
        key = x[at:to] @ y[:, :n]
        key *= scale
        np.rint(key, out=key)
        np.nan_to_num(key, copy=False, nan=-np.inf)
        key *= width
        key += place[:n]
        if earlier:
            key[np.arange(n)[None, :] >= low[at:to, None]] = -np.inf
        else:
            same = high[at:to] - low[at:to]
            rows = np.repeat(np.arange(to - at), same)
            key[rows, np.arange(same.sum()) - np.repeat(np.cumsum(same) - same, same) + np.repeat(low[at:to], same)] = -np.inf
        best = np.argmax(key, axis=1)[:, None] if k == 1 else np.argpartition(key, n - k, axis=1)[:, n - k :] if k < n else np.broadcast_to(np.arange(n), key.shape)
        value = np.take_along_axis(key, best, axis=1)
        rows, cols = np.nonzero(np.isfinite(value))
        picked = best[rows, cols]
        found.append(pd.DataFrame({"src": a[at + rows], "tgt": b[picked], "score": np.rint((value[rows, cols] - place[picked]) / width) / scale}))
    return pd.concat(found[1:] or found, ignore_index=True)


def nearest_in_block(vectors: DataFrame, k: int = 5, chunk: int = CHUNK, digits: int = 4) -> DataFrame:
    """(src, tgt, score, rank): for each row the k nearest others of its block, exactly.

    A block is dealt into pieces; each two pieces are one task with products of chunk rows, and only k rows of it per vector go
    on. So a task holds two pieces, however large a block is; its pairs are never rows."""
    ship(vectors.sparkSession)
    kind = vectors.schema["id"].dataType.simpleString()
    cells = pieces_of_blocks(vectors).groupBy("block", "i", "j").applyInPandas(lambda pdf: best_of_cell(pdf, k, chunk, digits), f"src {kind}, tgt {kind}, score double")
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("score"), "tgt")).cast("bigint")
    return cells.withColumn("rank", rank).where(F.col("rank") <= k)


def links_of(nearest: DataFrame) -> DataFrame:
    """(src_id, tgt_id, weight): undirected pairs of nearest rows, the larger score of both directions."""
    return nearest.groupBy(F.least("src", "tgt").alias("src_id"), F.greatest("src", "tgt").alias("tgt_id")).agg(F.max("score").alias("weight"))


def by_dimensions(vectors: DataFrame, query: list[float], k: int, blocks: list[str], minimum: float) -> DataFrame:
    """Vector search of twice k, then only given blocks and scores, then k."""
    hits = top_k(vectors, query, 2 * k, threshold=None).where(F.col("block").isin(*blocks) & (F.col("score") >= minimum))
    return hits.orderBy("rank").limit(k)


def weighted_score(hits: DataFrame, weights: dict[str, float], share: float, method: str = "weighted_sum") -> DataFrame:
    """hits with a combined score of the vector's and the block's weight: weighted_sum, multiplicative or vector_only."""
    table = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(v))])
    block = F.coalesce(F.try_element_at(table, F.col("block")), F.lit(1.0))
    combined = {"weighted_sum": F.col("score") * share + block * (1 - share), "multiplicative": F.col("score") * block, "vector_only": F.col("score")}[method]
    return hits.withColumn("combined", F.round(combined, 6))


def rerank(hits: DataFrame, importance: DataFrame, k: int, factor: float = 1000.0) -> DataFrame:
    """(id, score, final, rank): hits by factor * importance + score; importance(id, value), 0 where there is none."""
    rows = hits.select("id", "score").join(importance, "id", "left").withColumn("final", F.round(F.coalesce("value", F.lit(0)) * factor + F.col("score"), 4))
    best = rows.orderBy(F.desc("final"), "id").limit(k)
    return best.select("id", "score", "final", F.row_number().over(Window.orderBy(F.desc("final"), "id")).cast("bigint").alias("rank"))


def degree_among(hits: DataFrame, links: DataFrame) -> DataFrame:
    """(id, value): the different neighbours of a hit among the hits, 0 for one alone."""
    ids = hits.select("id")
    sym = links.select(F.col("src_id").alias("id"), F.col("tgt_id").alias("other")).union(links.select("tgt_id", "src_id"))
    inner = sym.join(ids, "id", "left_semi").join(ids.withColumnRenamed("id", "other"), "other", "left_semi")
    counted = inner.groupBy("id").agg(F.countDistinct("other").alias("value"))
    return ids.join(counted, "id", "left").select("id", F.coalesce("value", F.lit(0)).alias("value"))


def embed(docs: DataFrame, text: str, function, dim: int, batch: int = 256, out: str = "embedding") -> DataFrame:
    """docs with function(list of texts) -> vectors, by batches within a partition; the hook for an embedding model."""
    ship(docs.sparkSession)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            made: list = []
            for at in range(0, len(pdf), batch):
                made += [np.asarray(v, np.float32)[:dim].tolist() for v in function(pdf[text].iloc[at : at + batch].fillna("").tolist())]
            yield pdf.assign(**{out: made})

    return docs.mapInPandas(run, schema)
