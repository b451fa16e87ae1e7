"""Retrieval modes over a graph and its vectors: local, global, hybrid, mix and naive, under token budgets.

Inputs: nodes, links, degrees and chunks, and where they are stored, vectors of links and the chunks that entities and links come
from. All of them are DataFrames; what a mode keeps of each is bounded by top_k and the budgets, never collected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.vectors import cosine, literal
from graphloom.operators.budget import interleave, quotas, within_budget
from graphloom.operators.vector import top_k
from graphloom.schema import CHUNK_TOP_K, COSINE_THRESHOLD, MAX_ENTITY_TOKENS, MAX_RELATION_TOKENS, MAX_TOTAL_TOKENS, RELATED_CHUNKS, TOP_K
from graphloom.sources.tables import materialized


@dataclass(frozen=True)
class QueryParam:
    mode: str = "mix"
    top_k: int = TOP_K
    chunk_top_k: int = CHUNK_TOP_K
    max_entity_tokens: int = MAX_ENTITY_TOKENS
    max_relation_tokens: int = MAX_RELATION_TOKENS
    max_total_tokens: int = MAX_TOTAL_TOKENS
    threshold: float = COSINE_THRESHOLD
    related_chunks: int = RELATED_CHUNKS
    pick: str = "weight"


@dataclass(frozen=True)
class Graph:
    """nodes(id, block, embedding), links(src_id, tgt_id, weight), degrees(id, degree), chunks(id, tokens, embedding),
    link_vectors(src_id, tgt_id, weight, embedding), entity_sources(id, chunk_ids), link_sources(src_id, tgt_id, chunk_ids)."""

    nodes: DataFrame
    links: DataFrame
    degrees: DataFrame
    chunks: DataFrame | None = None
    link_vectors: DataFrame | None = None
    entity_sources: DataFrame | None = None
    link_sources: DataFrame | None = None


def local_entities(g: Graph, query: list[float], p: QueryParam) -> DataFrame:
    """(id, score, rank, degree) of the nearest nodes."""
    hits = top_k(g.nodes, query, p.top_k, p.threshold)
    return hits.join(g.degrees, "id", "left").select("id", "score", "rank", F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree"))


def local_relations(g: Graph, entities: DataFrame, most: int = MAX_RELATION_TOKENS) -> DataFrame:
    """(src_id, tgt_id, weight, edge_rank, rank): links at the entities, by the sum of their ends' degrees, then weight. A link
    takes a token at least, so no more than the budget of tokens are ranked: a hub's links don't meet in one task."""
    ids = entities.select("id")
    touched = g.links.join(ids, F.col("src_id") == F.col("id"), "left_semi").union(g.links.join(ids, F.col("tgt_id") == F.col("id"), "left_semi")).distinct()
    ends = lambda c, d: g.degrees.select(F.col("id").alias(c), F.col("degree").alias(d))
    rows = touched.join(ends("src_id", "ds"), "src_id").join(ends("tgt_id", "dt"), "tgt_id").select("src_id", "tgt_id", "weight", (F.col("ds") + F.col("dt")).alias("edge_rank"))
    order = (F.desc("edge_rank"), F.desc("weight"), F.col("src_id"), F.col("tgt_id"))
    return rows.orderBy(*order).limit(most).withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("bigint"))


def global_relations(g: Graph, query: list[float], p: QueryParam) -> DataFrame:
    """(src_id, tgt_id, weight, score, rank): the links nearest to the query by their own vectors; where links have none, a link's
    score is that of its better end's vector."""
    if g.link_vectors is not None:
        rows = g.link_vectors.select("src_id", "tgt_id", "weight", F.round(cosine(F.col("embedding"), literal(query)), 4).alias("score"))
    else:
        scored = g.nodes.select("id", F.round(cosine(F.col("embedding"), literal(query)), 4).alias("score"))
        ends = lambda c, s: scored.select(F.col("id").alias(c), F.col("score").alias(s))
        rows = g.links.join(ends("src_id", "ss"), "src_id").join(ends("tgt_id", "st"), "tgt_id").select("src_id", "tgt_id", "weight", F.greatest("ss", "st").alias("score"))
    best = rows.where(F.col("score") >= p.threshold).orderBy(F.desc("score"), "src_id", "tgt_id").limit(p.top_k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "src_id", "tgt_id")).cast("bigint"))


def related_chunks(owners: DataFrame, sources: DataFrame, key: list[str], p: QueryParam, chunks: DataFrame | None = None, query: list[float] | None = None, without: DataFrame | None = None) -> DataFrame:
    """(id, owner, n, rank): chunks of owners(key, rank) by sources(key, chunk_ids), but for those in without(id).

    A chunk belongs to the first owner that names it, n counts how often it is named. By weight, owners in order take
    falling quotas of the chunks that are named most, and unused quotas go to the first owners with more; by vector, the
    chunks nearest to the query, half of related_chunks for each owner on average. By vector falls back to by
    weight where there is no query or a chunk has no vector."""
    named = owners.select(*key, "rank").join(sources, key).select(F.struct(*key).alias("owner") if len(key) > 1 else F.col(key[0]).alias("owner"), "rank", F.posexplode("chunk_ids").alias("i", "id")).where("id is not null")
    if without is not None:
        named = named.join(without.select("id"), "id", "left_anti")
    named = materialized(named)
    at = F.struct("rank", "i")
    once = named.groupBy("id").agg(F.count("*").alias("n"), F.min_by("owner", at).alias("owner"), F.min(at).alias("first"))
    if p.pick == "vector" and chunks is not None and query is not None:
        seen = chunks.select("id", "embedding")
        if not once.join(seen.where("embedding is not null"), "id", "left_anti").limit(1).count():
            most = p.related_chunks * named.agg(F.countDistinct("owner").alias("n")).first().n // 2
            return top_k(once.join(seen, "id"), query, most, None).select("id", "owner", "n", "rank")
    sizes = named.groupBy("owner").agg(F.min("rank").alias("pos")).join(once.groupBy("owner").agg(F.count("*").alias("size")), "owner", "left")
    places = sizes.select("owner", F.coalesce("size", F.lit(0)).alias("size"), F.row_number().over(Window.orderBy("pos")).cast("bigint").alias("pos"))
    turn = F.row_number().over(Window.partitionBy("owner").orderBy(F.desc("n"), "first"))
    picked = once.join(quotas(places, p.related_chunks), "owner").withColumn("i", turn).where("i <= taken")
    # what an owner takes beyond its own quota stands after all that quotas gave
    order = Window.orderBy(F.col("i") > F.col("base"), "pos", "i")
    return picked.select("id", "owner", "n", F.row_number().over(order).cast("bigint").alias("rank"))


def global_entities(relations: DataFrame) -> DataFrame:
    """(id, rank): ends of the relations in the order in which they are met."""
    ends = relations.select(F.explode(F.array(F.struct(F.col("rank").alias("r"), F.lit(0).alias("side"), F.col("src_id").alias("id")), F.struct(F.col("rank").alias("r"), F.lit(1).alias("side"), F.col("tgt_id").alias("id")))).alias("e"))
    first = ends.groupBy(F.col("e.id").alias("id")).agg(F.min(F.struct("e.r", "e.side")).alias("f"))
    return first.select("id", F.row_number().over(Window.orderBy("f", "id")).cast("bigint").alias("rank"))


def naive_chunks(chunks: DataFrame, query: list[float], p: QueryParam) -> DataFrame:
    """(id, score, rank, tokens, used): the nearest chunks whose tokens fit into the whole budget."""
    hits = top_k(chunks, query, p.chunk_top_k, p.threshold)
    return within_budget(hits.select("id", "score", "rank", "tokens"), "tokens", p.max_total_tokens, ["rank"])


def retrieve(g: Graph, query: list[float], p: QueryParam, high: list[float] | None = None) -> dict[str, DataFrame]:
    """The entities, relations and chunks of a mode, before budgets on rendered text. query is the vector of the low-level keywords;
    high that of the high-level ones, for relations, where it differs. Where sources are stored, entity_chunks and
    relation_chunks are added, and all_chunks, with those of the search in turn. Unknown modes raise; bypass is empty."""
    out: dict[str, DataFrame] = {}
    if p.mode in ("local", "hybrid", "mix"):
        out["local_entities"] = local_entities(g, query, p)
        out["local_relations"] = local_relations(g, out["local_entities"], p.max_relation_tokens)
    if p.mode in ("global", "hybrid", "mix"):
        out["global_relations"] = global_relations(g, query if high is None else high, p)
        out["global_entities"] = global_entities(out["global_relations"])
    if p.mode in ("naive", "mix") and g.chunks is not None:
        out["chunks"] = naive_chunks(g.chunks, query, p)
    lists = [out[k] for k in ("local_entities", "global_entities") if k in out]
    if lists:
        out["entities"] = interleave(lists, "id")
    keyed = [out[k].withColumn("pair", F.struct("src_id", "tgt_id")) for k in ("local_relations", "global_relations") if k in out]
    if keyed:
        pairs = interleave(keyed, "pair")
        out["relations"] = pairs.withColumn("pair", F.concat_ws("|", F.col("pair.src_id").cast("string"), F.col("pair.tgt_id").cast("string")))
    if lists and g.entity_sources is not None:
        owners = out["entities"].select("id", F.col("place").alias("rank"))
        out["entity_chunks"] = related_chunks(owners, g.entity_sources, ["id"], p, g.chunks, query)
    if keyed and g.link_sources is not None:
        owners = pairs.select("pair.src_id", "pair.tgt_id", F.col("place").alias("rank"))
        out["relation_chunks"] = related_chunks(owners, g.link_sources, ["src_id", "tgt_id"], p, g.chunks, query, out.get("entity_chunks"))
    found = [out[k].select("id", "rank") for k in ("chunks", "entity_chunks", "relation_chunks") if k in out]
    if found:
        out["all_chunks"] = interleave(found, "id")
    if not out and p.mode not in ("bypass", "naive"):
        raise ValueError(f"no mode {p.mode!r}")
    return out


def merge_chunks(vector: DataFrame, of_entities: DataFrame, of_relations: DataFrame) -> DataFrame:
    """Chunks of three ranked lists in turn, each chunk once."""
    return interleave([vector, of_entities, of_relations], "id")



def keywords(query: str, high: list[str], low: list[str], short: int = 50) -> tuple[list[str], list[str]]:
    """Keywords of a query: as given; a short query without any stands for itself as a low-level one."""
    if not high and not low and len(query) < short:
        return [], [query]
    return high, low


def chunk_budget(total: int, prompt: int, context: int, query: int, reserve: int = 200) -> int:
    """Tokens left for chunks once the prompt, the graph's context and the query are counted."""
    return max(0, total - (prompt + context + query + reserve))


def context(entities: DataFrame, relations: DataFrame, chunks: DataFrame, param: QueryParam, prompt: int = 0, query: int = 0) -> dict[str, DataFrame]:
    """Ranked entities, relations and chunks(rank, text, tokens, ...) cut to their budgets; what the first two leave of the whole
    goes to chunks. One row of sums comes to the driver."""
    kept_e = within_budget(entities, "tokens", param.max_entity_tokens, ["rank"])
    kept_r = within_budget(relations, "tokens", param.max_relation_tokens, ["rank"])
    used = sum((df.agg(F.max("used")).first()[0] or 0) for df in (kept_e, kept_r))
    left = chunk_budget(param.max_total_tokens, prompt, int(used), query)
    return {"entities": kept_e, "relations": kept_r, "chunks": within_budget(chunks.limit(param.chunk_top_k) if "rank" not in chunks.columns else chunks.where(F.col("rank") <= param.chunk_top_k), "tokens", left, ["rank"])}


def records(rows: DataFrame, kind: str, columns: dict[str, str], default: str = "UNKNOWN") -> DataFrame:
    """(kind, rank, record): rows as JSON with the names a client expects; nulls become the default."""
    fields = [F.coalesce(F.col(c).cast("string"), F.lit(default)).alias(name) for name, c in columns.items()]
    return rows.select(F.lit(kind).alias("kind"), "rank", F.to_json(F.struct(*fields)).alias("record"))
