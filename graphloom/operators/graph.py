"""Graph reads and iterations over edges(edge_id, src_id, tgt_id, keywords, weight) and nodes(entity_id, dim1, dim2, description)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.sources.tables import materialized


def both_ways(edges: DataFrame) -> DataFrame:
    """(edge_id, a, b, keywords, weight): each edge from both of its ends."""
    back = edges.select("edge_id", F.col("tgt_id").alias("a"), F.col("src_id").alias("b"), "keywords", "weight")
    return edges.select("edge_id", F.col("src_id").alias("a"), F.col("tgt_id").alias("b"), "keywords", "weight").union(back)


def degrees(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(entity_id, degree); with nodes also those without an edge."""
    counted = edges.select(F.explode(F.array("src_id", "tgt_id")).alias("entity_id")).groupBy("entity_id").agg(F.count("*").alias("degree"))
    if nodes is None:
        return counted
    return nodes.select("entity_id").join(counted, "entity_id", "left").select("entity_id", F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree"))


def edge_degrees(edges: DataFrame) -> DataFrame:
    """Edges with the sum of their ends' degrees."""
    d = degrees(edges)
    out = edges.join(d.select(F.col("entity_id").alias("src_id"), F.col("degree").alias("ds")), "src_id").join(d.select(F.col("entity_id").alias("tgt_id"), F.col("degree").alias("dt")), "tgt_id")
    return out.select("edge_id", "src_id", "tgt_id", (F.col("ds") + F.col("dt")).alias("edge_degree"))


def neighbours(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, direction: str = "both", keyword: str | None = None) -> DataFrame:
    """(seed, neighbour, direction, keywords, weight, dim1) one hop from seeds(entity_id), identical rows once."""
    some = edges if keyword is None else edges.where(F.array_contains(F.split("keywords", ","), keyword))
    parts = []
    if direction in ("out", "both"):
        parts.append(some.join(seeds, F.col("src_id") == F.col("entity_id")).select(F.col("src_id").alias("seed"), F.col("tgt_id").alias("neighbour"), F.lit("out").alias("direction"), "keywords", "weight"))
    if direction in ("in", "both"):
        parts.append(some.join(seeds, F.col("tgt_id") == F.col("entity_id")).select(F.col("tgt_id").alias("seed"), F.col("src_id").alias("neighbour"), F.lit("in").alias("direction"), "keywords", "weight"))
    rows = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
    return rows.distinct().join(nodes.select(F.col("entity_id").alias("neighbour"), "dim1"), "neighbour").select("seed", "neighbour", "direction", "keywords", "weight", "dim1")


def two_hops(edges: DataFrame, seeds: DataFrame, exclude_self: bool = False) -> DataFrame:
    """(seed, middle, target, weight): paths of two edges, undirected; the second may be the first again unless exclude_self."""
    sym = both_ways(edges).select("a", "b", "weight")
    first = sym.join(seeds, F.col("a") == F.col("entity_id")).select(F.col("a").alias("seed"), F.col("b").alias("middle"), F.col("weight").alias("w1"))
    out = first.join(sym, F.col("middle") == F.col("a")).select("seed", "middle", F.col("b").alias("target"), (F.col("w1") + F.col("weight")).alias("weight"))
    return out.where("seed <> target") if exclude_self else out


def common_neighbours(edges: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """(common, left, right, weight) for different edges from a left and a right seed to one node."""
    sym = both_ways(edges)
    side = lambda seeds, s: sym.join(seeds, F.col("a") == F.col("entity_id")).select(F.col("a").alias(s), F.col("b").alias("common"), F.col("edge_id").alias(f"{s}_edge"), F.col("weight").alias(f"{s}_w"))
    both = side(left, "left").join(side(right, "right"), "common").where("left_edge <> right_edge")
    return both.select("common", "left", "right", (F.col("left_w") + F.col("right_w")).alias("weight"))


def paths_up_to_two(edges: DataFrame, seed: str) -> DataFrame:
    """(node, distance) for each path of one or two different edges from a seed, each pair once."""
    sym = both_ways(edges).select("edge_id", "a", "b")
    one = sym.where(F.col("a") == seed).select(F.col("edge_id").alias("e1"), F.col("b").alias("node"))
    two = one.join(sym, F.col("node") == F.col("a")).where("e1 <> edge_id").select(F.col("b").alias("node"), F.lit(2).alias("distance"))
    return one.select("node", F.lit(1).alias("distance")).union(two).distinct()


def met_within_two(edges: DataFrame, first: str, second: str) -> DataFrame:
    """(node, distance_1, distance_2): nodes that paths of one or two edges from both seeds reach, without the seeds."""
    one = both_ways(edges).where(F.col("a").isin(first, second)).select(F.col("a").alias("seed"), F.col("edge_id").alias("e1"), F.col("b").alias("node"))
    # written first, so that its size is known: a few neighbours go to the edges, not the edges to them; edges are made once for both seeds
    one = materialized(one)
    either = F.explode(F.array(F.struct(F.col("src_id").alias("a"), F.col("tgt_id").alias("b")), F.struct(F.col("tgt_id").alias("a"), F.col("src_id").alias("b"))))
    sym = edges.select("edge_id", either.alias("x")).select("edge_id", "x.a", "x.b")
    two = sym.join(one, F.col("a") == F.col("node")).where("e1 <> edge_id").select("seed", F.col("b").alias("node"), F.lit(2).alias("distance"))
    met = materialized(one.select("seed", "node", F.lit(1).alias("distance")).union(two).distinct())
    of = lambda seed, name: met.where(F.col("seed") == seed).select("node", F.col("distance").alias(name))
    return of(first, "distance_1").join(of(second, "distance_2"), "node").where(~F.col("node").isin(first, second))


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends in ids(entity_id)."""
    return edges.join(ids, F.col("src_id") == F.col("entity_id"), "left_semi").join(ids, F.col("tgt_id") == F.col("entity_id"), "left_semi")


def top_by_degree(edges: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """(entity_id, degree, rank): the n best linked nodes, of equal ones the smaller id."""
    best = degrees(edges, nodes).orderBy(F.desc("degree"), "entity_id").limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("degree"), "entity_id")).cast("bigint"))


def search_labels(nodes: DataFrame, query: str, n: int = 50) -> DataFrame:
    """(entity_id, score): exact 1000, prefix 500, else 100 less the length, and 50 more where a word begins with the query."""
    q, label = query.lower(), F.lower("description")
    inside = F.lit(100) - F.char_length("description") + F.when(label.contains(f" {q}") | label.contains(f"_{q}"), 50).otherwise(0)
    score = F.when(label == q, 1000).when(label.startswith(q), 500).otherwise(inside).cast("bigint")
    return nodes.where(label.contains(q)).select("entity_id", F.col("description").alias("label"), score.alias("score")).orderBy(F.desc("score"), "label", "entity_id").limit(n)


def text_search(nodes: DataFrame, query: str, n: int = 30) -> DataFrame:
    """Nodes whose id, description or type holds the query: exact ids first, then ids that hold it, then the others."""
    q = F.lit(query)
    hit = F.col("entity_id").contains(q) | F.col("description").contains(q) | F.col("dim1").contains(q) | F.col("dim2").contains(q)
    place = F.when(F.col("entity_id") == q, 0).when(F.col("entity_id").contains(q), 1).otherwise(2).cast("bigint")
    return nodes.where(hit).select("entity_id", "description", place.alias("place")).orderBy("place", "entity_id").limit(n)


def breadth_first(edges: DataFrame, seed: str, depth: int = 3, max_nodes: int = 1000) -> tuple[DataFrame, bool]:
    """((entity_id, level), truncated): levels in order, of the last one the best linked nodes up to max_nodes.

    Each level is a join of its frontier with the edges and an anti join with what was met; levels are bounded by depth,
    and what is kept by max_nodes."""
    sym = both_ways(edges).select("a", "b").distinct()
    ranks = degrees(edges)
    spark = edges.sparkSession
    seen = spark.createDataFrame([(seed, 0)], "entity_id string, level bigint")
    if not edges.where((F.col("src_id") == seed) | (F.col("tgt_id") == seed)).limit(1).count():
        return seen, False
    count = 1
    for level in range(1, depth + 1):
        frontier = seen.where(F.col("level") == level - 1).select(F.col("entity_id").alias("a"))
        new = sym.join(frontier, "a", "left_semi").select(F.col("b").alias("entity_id")).distinct().join(seen.select("entity_id"), "entity_id", "left_anti")
        room = max_nodes - count
        best = new.join(ranks, "entity_id").orderBy(F.desc("degree"), "entity_id").limit(room + 1)
        got = materialized(best.select("entity_id", F.lit(level).cast("bigint").alias("level")))
        found = got.count()
        if found > room:
            kept = got.join(ranks, "entity_id").orderBy(F.desc("degree"), "entity_id").limit(room).select("entity_id", "level")
            return seen.union(kept), True
        if not found:
            break
        seen, count = materialized(seen.union(got)), count + found
    return seen, False


def pagerank(edges: DataFrame, nodes: DataFrame, damping: float = 0.85, rounds: int = 40, cut_every: int = 10) -> DataFrame:
    """(entity_id, pagerank), undirected: (1 - d) + d * sum of neighbours' rank / degree. The lineage is cut by a written table now and then."""
    sym = materialized(both_ways(edges).select("a", "b"))
    out = sym.groupBy("a").agg(F.count("*").alias("out"))
    links = materialized(sym.join(out, "a"))
    ranks = nodes.select("entity_id").distinct().withColumn("pagerank", F.lit(1.0 - damping))
    for k in range(rounds):
        sent = links.join(ranks, F.col("a") == F.col("entity_id")).groupBy(F.col("b").alias("entity_id")).agg(F.sum(F.col("pagerank") / F.col("out")).alias("got"))
        ranks = nodes.select("entity_id").distinct().join(sent, "entity_id", "left").select("entity_id", (F.lit(1.0 - damping) + F.lit(damping) * F.coalesce("got", F.lit(0.0))).alias("pagerank"))
        if k % cut_every == cut_every - 1:
            ranks = materialized(ranks)
    return ranks


def roots(parents: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, root) from (node, parent) pointers without cycles: pointers are doubled until none moves; a node without one is its own root."""
    every = parents.select("node").union(parents.select(F.col("parent").alias("node"))).distinct()
    now = materialized(every.join(parents, "node", "left").select("node", F.coalesce("parent", "node").alias("root")))
    for _ in range(max_rounds):
        up = now.select(F.col("node").alias("root"), F.col("root").alias("higher"))
        after = materialized(now.join(up, "root").select("node", F.col("higher").alias("root"), (F.col("higher") != F.col("root")).alias("moved")))
        now = after.select("node", "root")
        if not after.where("moved").limit(1).count():
            if now.where("node = root").join(parents.where("node <> parent").select("node"), "node", "left_semi").limit(1).count():
                break
            return now
    raise ValueError("the pointers hold a cycle")
