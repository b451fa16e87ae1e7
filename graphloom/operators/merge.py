"""Merging entities and relations, and rewriting ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import pair_key
from graphloom.operators.extract import ordered
from graphloom.schema import SEP, SOURCE_IDS_LIMIT, UNKNOWN


def vote(rows: DataFrame, key: str, list_column: str, order: str, share: float = 0.7) -> DataFrame:
    """(key, types): of the types in a group's comma lists the most frequent, and the second and third as long as each has
    at least ceil(share * members) votes; ties go to the type met first."""
    parts = rows.select(key, order, F.posexplode(F.split(list_column, ",")).alias("i", "type")).withColumn("type", F.trim("type")).where("type <> ''")
    votes = parts.groupBy(key, "type").agg(F.count("*").alias("n"), F.min(F.struct(order, "i")).alias("first"))
    members = rows.groupBy(key).agg(F.count("*").alias("members"))
    ranked = votes.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "first"))).where("rank <= 3").join(members, key)
    enough = (F.col("rank") == 1) | (F.col("n") >= F.ceil(F.col("members") * share))
    # counts fall with the rank, so the second fails wherever the third would go on alone
    return ranked.where(enough).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "type"))), lambda s: s["type"]), ",").alias("types"))


def merge_groups(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Entities(entity_id, dim1, dim2, description, source_id) of a key as one: the first is the base; dim1 as a union, dim2 by
    vote, descriptions and sources in order, merged_from and merge_count kept."""
    lists = rows.groupBy(key).agg(
        F.min_by("entity_id", order).alias("entity_id"), ordered("entity_id", order).alias("ids"), ordered("dim1", order).alias("d1"),
        ordered("description", order).alias("d"), ordered("source_id", order).alias("s"), F.count("*").alias("merge_count"),
    )
    types = F.array_distinct(F.filter(F.flatten(F.transform("d1", lambda x: F.transform(F.split(x, ","), lambda x: F.trim(x)))), lambda x: x != ""))
    sources = F.array_distinct(F.flatten(F.transform("s", lambda x: F.split(x, SEP))))
    merged = lists.select(key, "entity_id", F.array_join(types, ",").alias("dim1"), F.array_join(F.filter("d", lambda x: x != ""), SEP).alias("description"), F.array_join(sources, SEP).alias("source_id"), F.array_join("ids", SEP).alias("merged_from"), "merge_count")
    return merged.join(vote(rows, key, "dim2", order), key, "left").withColumnRenamed("types", "dim2")


def mapping(merged: DataFrame) -> DataFrame:
    """(old_id, new_id) of every id that an entity was merged from."""
    return merged.select(F.explode(F.array_union(F.split("merged_from", SEP), F.array("entity_id"))).alias("old_id"), F.col("entity_id").alias("new_id")).groupBy("old_id").agg(F.max("new_id").alias("new_id"))


def rewrite_ends(edges: DataFrame, ids: DataFrame, surviving: DataFrame | None = None) -> DataFrame:
    """Ends through a mapping; ids without one stay, self-links go, and edges whose ends don't survive go."""
    one = lambda side: ids.select(F.col("old_id").alias(side), F.col("new_id").alias(f"{side}_new"))
    out = edges.join(one("src_id"), "src_id", "left").join(one("tgt_id"), "tgt_id", "left")
    out = out.withColumns({"src_id": F.coalesce("src_id_new", "src_id"), "tgt_id": F.coalesce("tgt_id_new", "tgt_id")}).drop("src_id_new", "tgt_id_new").where("src_id <> tgt_id")
    return out if surviving is None else with_both_ends(out, surviving)


def with_both_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends are both nodes."""
    ids = nodes.select("entity_id").distinct()
    return edges.join(ids, F.col("src_id") == F.col("entity_id"), "left_semi").join(ids, F.col("tgt_id") == F.col("entity_id"), "left_semi")


def merge_relations(edges: DataFrame, order: str = "edge_id") -> DataFrame:
    """Relations of one pair as one: weights summed, keywords sorted and each once, descriptions each once in order. A pair
    with one relation keeps it as it is."""
    g = edges.groupBy("src_id", "tgt_id").agg(F.sum("weight").alias("weight"), F.count("*").alias("n"), ordered("keywords", order).alias("k"), ordered("description", order).alias("d"))
    words = F.array_sort(F.array_distinct(F.filter(F.transform(F.flatten(F.transform("k", lambda x: F.split(x, ","))), lambda x: F.trim(x)), lambda x: x != "")))
    return g.select("src_id", "tgt_id", "weight", F.col("n").alias("n_merged"), F.when(F.col("n") == 1, F.col("k")[0]).otherwise(F.array_join(words, ",")).alias("keywords"), F.array_join(F.array_distinct("d"), SEP).alias("description"))


def standardize_relations(rows: DataFrame) -> DataFrame:
    """Aliases of the ends resolved, weight 1.0 where there is none, rows without an end and self-links dropped."""
    pick = lambda *names: F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names if n in rows.columns])
    out = rows.select(pick("src_id", "source", "src").alias("src_id"), pick("tgt_id", "target", "tgt").alias("tgt_id"), F.coalesce(F.col("keywords"), F.lit("")).alias("keywords"), F.coalesce(F.expr("try_cast(weight as double)"), F.lit(1.0)).alias("weight"), pick("source_chunk_id", "source_id").alias("source_chunk_id"))
    return out.where("src_id is not null and tgt_id is not null and src_id <> tgt_id")


def standardize_entities(rows: DataFrame) -> DataFrame:
    """entity_id, else entity_name, as the id; rows without either are dropped."""
    return rows.withColumn("entity_id", F.coalesce(F.nullif("entity_id", F.lit("")), F.nullif("entity_name", F.lit("")))).where("entity_id is not null")


def _newest_sources(rows: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """(keys, source_id, n_sources): a key's sources in the order in which they are first met, the last limit of them. Repeats go
    and what is over the limit is cut before anything is collected, so that a hub isn't one task's list."""
    once = rows.groupBy(*keys, "source_id").agg(F.min(F.struct("age", "ts")).alias("first"))
    counts = once.groupBy(*keys).agg(F.count("*").alias("n_sources"))
    newest = Window.partitionBy(*keys).orderBy(F.desc("first"), F.desc("source_id"))
    kept = once.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= limit)
    lists = kept.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "source_id"))), lambda x: x["source_id"]), SEP).alias("source_id"))
    return counts.join(lists, keys, "left").withColumn("source_id", F.coalesce("source_id", F.lit("")))


def upsert_nodes(old: DataFrame, new: DataFrame, limit: int = SOURCE_IDS_LIMIT) -> DataFrame:
    """Nodes(entity_id, entity_type, description, source_id, ts) upserted: the most frequent type (of equal ones the smaller),
    descriptions each once by time and length, existing ones first, sources in order up to a limit, the newest kept."""
    rows = old.withColumn("age", F.lit(0)).unionByName(new.withColumn("age", F.lit(1)))
    counts = rows.groupBy("entity_id", "entity_type").agg(F.count("*").alias("n"))
    chosen = counts.groupBy("entity_id").agg(F.min(F.struct((-F.col("n")).alias("minus"), "entity_type"))["entity_type"].alias("entity_type"))
    # each description once before they are collected
    once = rows.groupBy("entity_id", "description").agg(F.min(F.struct("age", "ts", (-F.char_length("description")).alias("len"))).alias("first"))
    told = once.groupBy("entity_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "description"))), lambda x: x["description"]), SEP).alias("description"))
    both = told.join(_newest_sources(rows, ["entity_id"], limit), "entity_id").join(chosen, "entity_id")
    return both.select("entity_id", "description", "source_id", "n_sources", "entity_type")


def upsert_edges(old: DataFrame, new: DataFrame, limit: int = SOURCE_IDS_LIMIT) -> DataFrame:
    """Undirected edges(src_id, tgt_id, weight, keywords, source_id, ts) upserted under the sorted pair: weights summed, keywords sorted.
    Edges without either end are dropped."""
    rows = old.withColumn("age", F.lit(0)).unionByName(new.withColumn("age", F.lit(1)))
    keyed = rows.withColumns({"a": F.least("src_id", "tgt_id"), "b": F.greatest("src_id", "tgt_id")})
    sums = keyed.groupBy("a", "b").agg(F.sum("weight").alias("weight"))
    words = keyed.select("a", "b", F.explode_outer(F.split("keywords", ",")).alias("word")).groupBy("a", "b").agg(F.array_join(F.array_sort(F.collect_set("word")), ",").alias("keywords"))
    both = sums.join(words, ["a", "b"]).join(_newest_sources(keyed, ["a", "b"], limit), ["a", "b"])
    return both.select(F.col("a").alias("src_id"), F.col("b").alias("tgt_id"), pair_key(F.col("a"), F.col("b")).alias("edge_key"), "weight", "keywords", "source_id")


def missing_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """A node of unknown type for each end that isn't a node."""
    ends = edges.select(F.explode(F.array("src_id", "tgt_id")).alias("entity_id")).distinct()
    return ends.join(nodes.select("entity_id"), "entity_id", "left_anti").withColumn("entity_type", F.lit(UNKNOWN))


def merge_attribute(strategy: str, column: str, order: str) -> Column:
    """An attribute of merged rows: concatenate, keep_first, keep_last, join_unique, join_unique_comma or max."""
    values = F.filter(ordered(column, order), lambda x: x.isNotNull() & (x.cast("string") != ""))
    parts = lambda sep: F.array_sort(F.array_distinct(F.filter(F.transform(F.flatten(F.transform(values, lambda x: F.split(x.cast("string"), sep))), lambda x: F.trim(x)), lambda x: x != "")))
    match strategy:
        case "concatenate":
            return F.array_join(values, SEP)
        case "keep_first":
            return F.get(values, F.lit(0))
        case "keep_last":
            return F.get(values, F.size(values) - 1)
        case "join_unique":
            return F.array_join(parts(SEP), SEP)
        case "join_unique_comma":
            return F.array_join(parts(","), ",")
        case "max":
            return F.max(F.expr(f"try_cast({column} as double)"))
    raise ValueError(strategy)


NODE_STRATEGIES = {"description": "concatenate", "dim1": "keep_first", "dim2": "join_unique_comma", "source_id": "join_unique", "file_path": "join_unique"}
EDGE_STRATEGIES = {"description": "concatenate", "keywords": "join_unique_comma", "source_id": "join_unique", "file_path": "join_unique", "weight": "max"}


def _merged(rows: DataFrame, keys: list[str], columns: list[str], strategies: dict[str, str], order: str) -> DataFrame:
    return rows.groupBy(*keys).agg(*[merge_attribute(strategies.get(c, "keep_first"), c, order).alias(c) for c in columns if c not in keys])


def merge_nodes(nodes: DataFrame, edges: DataFrame, sources: DataFrame, target: str, node_strategies: dict[str, str] | None = None, edge_strategies: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes listed in sources(entity_id) become target, which keeps its place as the first of them: attributes merge by strategy,
    edges that touch a source move, self-links among them go, and moved edges that meet another between the same ends
    (either way round) merge with it. Other nodes and edges stay as they are, parallel ones too. Returns (nodes, edges).

    A target that isn't a node yet becomes one. Sources that aren't nodes add nothing."""
    gone = sources.select(F.col("entity_id").alias("old_id")).where(F.col("old_id") != target).distinct()
    joined = nodes.join(gone, F.col("entity_id") == F.col("old_id"), "left").withColumn("\x01in", F.col("old_id").isNotNull() | (F.col("entity_id") == target)).drop("old_id")
    # the target first, then sources by their ids
    place = F.struct((F.col("entity_id") != target).alias("later"), F.col("entity_id").alias("id"))
    taken = joined.where("`\x01in`").withColumn("\x01place", place).withColumn("entity_id", F.lit(target))
    one = _merged(taken, ["entity_id"], nodes.columns, NODE_STRATEGIES | (node_strategies or {}), "\x01place")
    new_nodes = joined.where("not `\x01in`").select(*nodes.columns).unionByName(one.select(*nodes.columns))
    swap = lambda side: F.when(F.col(f"{side}_old").isNotNull(), F.lit(target)).otherwise(F.col(side))
    ends = lambda side: gone.select(F.col("old_id").alias(f"{side}_old"))
    every = edges.join(ends("src_id"), F.col("src_id") == F.col("src_id_old"), "left").join(ends("tgt_id"), F.col("tgt_id") == F.col("tgt_id_old"), "left")
    touched = F.col("src_id_old").isNotNull() | F.col("tgt_id_old").isNotNull()
    moved = every.where(touched).withColumns({"src_id": swap("src_id"), "tgt_id": swap("tgt_id")}).drop("src_id_old", "tgt_id_old").where("src_id <> tgt_id").withColumn("\x01moved", F.lit(1))
    still = every.where(~touched).drop("src_id_old", "tgt_id_old").withColumn("\x01moved", F.lit(0))
    # only edges at the target can meet a moved one
    at_target = (F.col("src_id") == target) | (F.col("tgt_id") == target)
    met = still.where(at_target).unionByName(moved).withColumns({"\x01a": F.least("src_id", "tgt_id"), "\x01b": F.greatest("src_id", "tgt_id")})
    pairs = met.groupBy("\x01a", "\x01b").agg(F.max("\x01moved").alias("\x01any"))
    both = met.join(pairs, ["\x01a", "\x01b"])
    order = "\x01order"
    named = [c for c in ("edge_id", "keywords") if c in edges.columns]
    grouped = both.where("`\x01any` = 1").withColumn(order, F.struct("\x01moved", "src_id", "tgt_id", *named))
    joined_edges = _merged(grouped, ["\x01a", "\x01b"], edges.columns, EDGE_STRATEGIES | (edge_strategies or {}), order).select(*edges.columns)
    rest = still.where(~at_target).select(*edges.columns).unionByName(both.where("`\x01any` = 0").select(*edges.columns))
    kinds = {f.name: f.dataType for f in edges.schema}
    return new_nodes, rest.unionByName(joined_edges.select(*[F.col(c).cast(kinds[c]).alias(c) for c in edges.columns]))
