"""More registered queries: scalar functions, predicates, summaries, hooks with stand-ins, and maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom import fixtures as fx
from graphloom.functions import text
from graphloom.operators import budget, extract, graph, hooks, maintain, merge, stats
from graphloom.plans import ingest, retrieve
from graphloom.queries import query
from graphloom.schema import DIM1_TYPES, DIM2_TYPES, FIELD, OTHER_TYPE, SEP
from graphloom.sources import tables

# --- scalar functions and predicates -----------------------------------------------------------------------------------------


@query(
    """SELECT p_partkey, CASE WHEN p_size % 3 = 0 AND p_size > 0 THEN 'P' || p_size END AS problem, CASE WHEN p_size % 3 = 0 THEN 'Luogu' WHEN p_size % 3 = 1 THEN 'Codeforces' ELSE '未知题库' END AS platform, p_name AS base FROM part"""
)
def problem_ids(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    head = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("P"), size)).when(F.col("p_size") % 3 == 1, F.concat(F.lit("cf"), size, F.lit("a"))).otherwise("words")
    rows = fx.table(spark, d, "part").withColumn("entity_id", F.when(F.col("p_size") % 3 == 1, head).otherwise(F.concat(head, F.lit(" "), "p_name")))
    return rows.select("p_partkey", text.problem_id(F.col("entity_id")).alias("problem"), text.platform(head).alias("platform"), text.base_name(F.concat("p_name", F.lit("<a1b2c3>"))).alias("base"))


@query("SELECT o_orderkey, least(o_orderstatus, o_orderpriority) || '<SEP>' || greatest(o_orderstatus, o_orderpriority) AS pair, 'mix:extract:' || md5(o_orderpriority) AS cache_key, md5(o_orderpriority) AS digest, regexp_matches(o_totalprice::VARCHAR, '^[-+]?[0-9]*\\.?[0-9]+$') AS is_float FROM orders")
def keys_and_checks(spark: SparkSession, d: str) -> DataFrame:
    key = text.cache_key(F.lit("mix"), F.lit("extract"), F.md5("o_orderpriority"))
    return fx.table(spark, d, "orders").select("o_orderkey", text.pair_key(F.col("o_orderstatus"), F.col("o_orderpriority")).alias("pair"), key.alias("cache_key"), text.parse_cache_key(key)["digest"].alias("digest"), text.is_float(F.col("o_totalprice").cast("string")).alias("is_float"))


@query("SELECT doc_id, len(list_filter(list_transform(regexp_split_to_array(text, '\\n|, '), lambda x: trim(x, ' ')), lambda x: x <> ''))::BIGINT AS parts, length(trim(text, ' '))::BIGINT AS n FROM documents")
def marker_split(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "documents").select("doc_id", F.size(text.split_markers(F.col("text"), "\n", ", ")).cast("bigint").alias("parts"), F.char_length(F.trim("text")).cast("bigint").alias("n"))


@query("SELECT conv_id, turn, trim(text, ' ') AS answer, '{\"k\": ' || turn || '}' AS json FROM conversations")
def model_answers(spark: SparkSession, d: str) -> DataFrame:
    answer = F.concat(F.lit("<think>first\nthen</think> "), "text")
    fenced = F.concat(F.lit('Sure:\n```json\n{"k": '), F.col("turn").cast("string"), F.lit("}\n```\nDone"))
    return fx.table(spark, d, "conversations").select("conv_id", "turn", text.without_thinking(answer).alias("answer"), text.fenced_json(fenced).alias("json"))


@query(
    """SELECT p_partkey FROM (SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN '图论' WHEN p_size % 4 = 1 THEN 'UNKNOWN' WHEN p_size % 4 = 2 THEN '图论,搜索' ELSE '其他' END AS d1, CASE WHEN p_size % 5 = 0 THEN '概念,技巧' WHEN p_size % 5 = 1 THEN '' WHEN p_size % 5 = 2 THEN '概念,else' ELSE '算法' END AS d2 FROM part)
WHERE d1 IN ('UNKNOWN', '图论,搜索') OR d2 IN ('', '概念,else')"""
)
def types_to_mend(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("p_size") % 4, F.col("p_size") % 5
    d1 = F.when(a == 0, "图论").when(a == 1, "UNKNOWN").when(a == 2, "图论,搜索").otherwise("其他")
    d2 = F.when(b == 0, "概念,技巧").when(b == 1, "").when(b == 2, "概念,else").otherwise("算法")
    return fx.table(spark, d, "part").where(text.needs_retyping(d1, d2, (*DIM1_TYPES, OTHER_TYPE), (*DIM2_TYPES, OTHER_TYPE))).select("p_partkey")


@query("SELECT event_id, trim(regexp_replace(props, '[{}]', '', 'g')) AS clean FROM events")
def sanitized_text(spark: SparkSession, d: str) -> DataFrame:
    dirty = F.concat(F.lit("\x00 "), F.regexp_replace("props", "[{}]", "\x07"), F.lit(" \x1f"))
    return fx.table(spark, d, "events").select("event_id", text.clean_control(dirty).alias("clean"))


# --- extraction plan, hooks --------------------------------------------------------------------------------------------------


@query(f"WITH {fx.RAW_SQL} SELECT file_path || '/' || chunk_id AS prompt_id, CASE WHEN doc_id % 2 = 0 THEN 'cached' ELSE upper(file_path) END AS response FROM raw")
def cached_model_calls(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.responses(spark, d).select(F.concat_ws("/", "file_path", "chunk_id").alias("prompt_id"), "file_path", "doc_id")
    cache = rows.where("doc_id % 2 = 0").select(hooks.prompt_key("default", "extract", F.col("file_path")).alias("key"), F.lit("cached").alias("response")).distinct()
    return hooks.call_with_cache(rows, "file_path", cache, lambda prompt: prompt.upper())[0].select("prompt_id", "response")


@query(
    f"""WITH {fx.RAW_SQL}, a AS (SELECT chunk_id, name, dim1, dim2, description, 0::BIGINT AS round FROM ent), b AS (SELECT chunk_id, name, dim1, dim2, CASE WHEN pos % 2 = 0 THEN description || '!' ELSE substr(description, 1, 3) END, 1 FROM ent),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b) SELECT chunk_id, name, dim1, dim2, description, round FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id, name ORDER BY length(description) DESC, round) AS rank FROM u) WHERE rank = 1"""
)
def gleaning(spark: SparkSession, d: str) -> DataFrame:
    first = extract.entities(fx.responses(spark, d)).select("chunk_id", "name", "dim1", "dim2", "description", "pos")
    second = first.withColumn("description", F.when(F.col("pos") % 2 == 0, F.concat("description", F.lit("!"))).otherwise(F.substring("description", 1, 3)))
    return hooks.glean(first.drop("pos"), second.drop("pos"))


@query(
    f"""WITH d AS (SELECT o_custkey AS key, o_orderpriority AS v, min(o_orderkey) AS f FROM orders GROUP BY 1, 2), g AS (SELECT key, count(*) AS n, string_agg(v, '{SEP}' ORDER BY f) AS joined FROM d GROUP BY 1)
SELECT key, CASE WHEN n <= 4 THEN joined ELSE n || ' parts' END AS description, n AS parts, n > 4 AS by_model FROM g"""
)
def description_summaries(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.table(spark, d, "orders").select(F.col("o_custkey").alias("key"), "o_orderpriority", "o_orderkey")
    return hooks.summarize(rows, "key", "o_orderpriority", "o_orderkey", lambda joined: f"{joined.count('<SEP>') + 1} parts")


def _stand_in(prompt: str) -> str:
    """A model that names the first two words of a chunk and relates them."""
    parts = (prompt.split() + ["none", "none"])[:2]
    return f"entity{FIELD}{parts[0]}{FIELD}word{FIELD}first{FIELD}begins a chunk\nrelation{FIELD}{parts[0]}{FIELD}{parts[1]}{FIELD}IS_A{FIELD}stands before{'<|COMPLETE|>'}"


_CHUNKS = "w AS (SELECT doc_id, 'doc-' || md5(trim(text, ' ')) AS file_path, string_split(trim(trim(text, ' '), ' '), ' ') AS t FROM (SELECT min(doc_id) AS doc_id, text FROM documents WHERE trim(text, ' ') <> '' GROUP BY trim(text, ' '), text)), c AS (SELECT file_path, t, unnest(range(0, len(t), 150)) AS beg FROM w), k AS (SELECT file_path, beg, regexp_extract_all(array_to_string(t[beg + 1:beg + 200], ' '), '[^\\x20\\x09-\\x0D]+') AS p FROM c)"


@query(f"WITH {_CHUNKS} SELECT file_path, p[1] AS name, 'word' AS dim1, 'first' AS dim2, 'begins a chunk' AS description FROM k GROUP BY 1, 2")
def extract_plan(spark: SparkSession, d: str) -> DataFrame:
    got = ingest.extract_graph(fx.table(spark, d, "documents"), _stand_in, size=200, overlap=50)
    return got.entities.where("data_source = 'extracted'").select("file_path", "name", "dim1", "dim2", "description")


@query()
def merge_plan(spark: SparkSession, d: str) -> DataFrame:
    ents = _graph_entities(spark, d)
    rels = fx.edges(spark, d).withColumn("description", F.col("keywords"))
    roots = ents.join(ents.groupBy("dim2").agg(F.min("pos").alias("root")), "dim2").select(F.col("pos").alias("id"), "root")
    return ingest.merge_graph(ents, rels, roots)[1]


def _graph_entities(spark: SparkSession, d: str) -> DataFrame:
    return fx.nodes(spark, d).withColumns({"pos": F.col("entity_id"), "source_id": F.concat(F.lit("chunk-"), "entity_id")})


@query(
    """WITH ch AS (SELECT 's' || doc_id AS source_id, 'chunk-' || md5(trim(text, ' ')) AS chunk_id FROM documents), e AS (SELECT 'c:' || c_custkey AS entity_id, 's' || (c_custkey % 200) AS source_id FROM customer),
r AS (SELECT 'c:' || o_custkey AS a, 'o:' || (o_orderkey % 50) AS b FROM orders), miss AS (SELECT DISTINCT x FROM (SELECT a AS x FROM r UNION ALL SELECT b FROM r) WHERE x NOT IN (SELECT entity_id FROM e))
SELECT entity_id, coalesce(chunk_id, 'UNKNOWN') AS chunk_id FROM e LEFT JOIN ch USING (source_id) UNION ALL SELECT x, 'UNKNOWN' FROM miss"""
)
def custom_graph(spark: SparkSession, d: str) -> DataFrame:
    chunks = fx.table(spark, d, "documents").select(F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("source_id"), F.col("text").alias("content"))
    c = fx.table(spark, d, "customer")
    entities = c.select(F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("entity_name"), F.concat(F.lit("s"), (F.col("c_custkey") % 200).cast("string")).alias("source_id"), F.lit("customer").alias("dim1"))
    o = fx.table(spark, d, "orders")
    relations = o.select(F.concat(F.lit("c:"), F.col("o_custkey").cast("string")).alias("src_id"), F.concat(F.lit("o:"), (F.col("o_orderkey") % 50).cast("string")).alias("tgt_id"), F.lit("s1").alias("source_id"))
    return ingest.insert_custom(chunks, entities, relations)[1].select("entity_id", "chunk_id")


# --- graph and tables --------------------------------------------------------------------------------------------------------


@query(f"WITH {fx.NODES_SQL}, {fx.EDGES_SQL} SELECT a, b, keywords, weight FROM sym WHERE a = 'p:7'")
def node_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.both_ways(fx.edges(spark, d)).where("a = 'p:7'").select("a", "b", "keywords", "weight")


@query(f"WITH {fx.NODES_SQL} SELECT DISTINCT dim2 AS label FROM nodes")
def all_labels(spark: SparkSession, d: str) -> DataFrame:
    return fx.nodes(spark, d).select(F.col("dim2").alias("label")).distinct()


@query(f"WITH {fx.NODES_SQL}, {fx.EDGES_SQL} SELECT DISTINCT s.b AS entity_id, dim1, weight, s.a < s.b AS is_first FROM sym s JOIN nodes n ON n.entity_id = s.b WHERE a = 'n:2' AND dim1 IN ('supplier', 'region')")
def related_by_type(spark: SparkSession, d: str) -> DataFrame:
    near = graph.neighbours(fx.edges(spark, d), fx.nodes(spark, d), spark.createDataFrame([("n:2",)], "entity_id string"))
    return near.where(F.col("dim1").isin("supplier", "region")).select(F.col("neighbour").alias("entity_id"), "dim1", "weight", (F.col("seed") < F.col("neighbour")).alias("is_first")).distinct()


@query(f"WITH {fx.PLACES_SQL}, gone AS (SELECT 'n:' || n_nationkey AS id FROM nation WHERE n_regionkey = 2) SELECT edge_id, src_id, tgt_id, keywords, weight FROM places WHERE src_id NOT IN (SELECT id FROM gone) AND tgt_id NOT IN (SELECT id FROM gone)")
def delete_nodes(spark: SparkSession, d: str) -> DataFrame:
    nodes = fx.nodes(spark, d)
    return maintain.delete_nodes(nodes, fx.places(spark, d), nodes.where("dim2 = 'region 2'").select("entity_id"))[1]


@query(f"WITH {fx.PLACES_SQL} SELECT edge_id, CASE WHEN src_id = 'n:4' THEN 'n:four' ELSE src_id END AS src_id, CASE WHEN tgt_id = 'n:4' THEN 'n:four' ELSE tgt_id END AS tgt_id, keywords, weight FROM places")
def rename_node(spark: SparkSession, d: str) -> DataFrame:
    return maintain.rename(fx.nodes(spark, d), fx.places(spark, d), "n:4", "n:four")[1]


@query(f"WITH {fx.EDGES_SQL}, kept AS (SELECT 'c:' || c_custkey AS id FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT 'p:' || p_partkey FROM part WHERE p_partkey % 3 = 0) SELECT edge_id FROM edges WHERE src_id IN (SELECT id FROM kept) AND tgt_id IN (SELECT id FROM kept)")
def endpoint_check(spark: SparkSession, d: str) -> DataFrame:
    nodes = fx.nodes(spark, d).where("(dim1 = 'customer' and cast(substring(entity_id, 3) as int) % 2 = 0) or (dim1 = 'part' and cast(substring(entity_id, 3) as int) % 3 = 0)")
    return merge.with_both_ends(fx.edges(spark, d), nodes).select("edge_id")


@query(f"WITH {fx.NODES_SQL}, {fx.PLACES_SQL} SELECT edge_id, CASE WHEN x.dim1 = y.dim1 THEN x.dim1 ELSE 'extra' END AS part FROM places JOIN nodes x ON x.entity_id = src_id JOIN nodes y ON y.entity_id = tgt_id")
def edge_partitions(spark: SparkSession, d: str) -> DataFrame:
    dim = lambda c, n: fx.nodes(spark, d).select(F.col("entity_id").alias(c), F.col("dim1").alias(n))
    rows = fx.places(spark, d).join(dim("src_id", "x"), "src_id").join(dim("tgt_id", "y"), "tgt_id")
    return rows.select("edge_id", F.when(F.col("x") == F.col("y"), F.col("x")).otherwise("extra").alias("part"))


@query("SELECT i::BIGINT AS pos, i * 3 AS c_custkey, c_name FROM range(0, 1000) t(i) LEFT JOIN customer ON c_custkey = i * 3")
def multi_get(spark: SparkSession, d: str) -> DataFrame:
    wanted = spark.range(1000).select(F.col("id").alias("pos"), (F.col("id") * 3).alias("c_custkey"))
    return tables.get_many(fx.table(spark, d, "customer").select("c_custkey", "c_name"), wanted, "c_custkey").select("pos", "c_custkey", "c_name")


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 4 = 0)")
def keys_not_stored(spark: SparkSession, d: str) -> DataFrame:
    stored = fx.table(spark, d, "customer").where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("o_custkey"))
    return tables.new_keys(fx.table(spark, d, "orders"), stored, "o_custkey")


@query("SELECT user_id AS id, arg_max(event_type, (ts, event_type)) AS status FROM events GROUP BY 1")
def status_moves(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("status"), F.col("ts").alias("updated_at"))
    odd = F.second("updated_at") % 2 == 1
    return maintain.move(rows.where(~odd), rows.where(odd)).select("id", "status")


@query("SELECT doc_id, ntile(7) OVER (ORDER BY doc_id)::BIGINT AS part FROM documents")
def document_groups(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "documents").select("doc_id", F.ntile(7).over(Window.orderBy("doc_id")).cast("bigint").alias("part"))


@query("WITH a AS (SELECT l_partkey AS id, row_number() OVER (ORDER BY sum(l_quantity) DESC, l_partkey) AS rank FROM lineitem GROUP BY 1), b AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part), c AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY p_size, p_partkey) AS rank FROM part) SELECT id, source, rank, row_number() OVER (ORDER BY rank, source) AS place FROM (SELECT id, min((rank, source))[1] AS rank, min((rank, source))[2] AS source FROM (SELECT id, 0::BIGINT AS source, rank FROM a WHERE rank <= 50 UNION ALL SELECT id, 1, rank FROM b WHERE rank <= 50 UNION ALL SELECT id, 2, rank FROM c WHERE rank <= 50) GROUP BY id)")
def merge_three_lists(spark: SparkSession, d: str) -> DataFrame:
    part = fx.table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_retailprice", "p_size")
    sold = fx.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.sum("l_quantity").alias("q"))
    ranked = lambda df, *by: df.orderBy(*by).limit(50).withColumn("rank", F.row_number().over(Window.orderBy(*by)))
    return budget.interleave([ranked(sold, F.desc("q"), "id"), ranked(part, F.desc("p_retailprice"), "id"), ranked(part, F.col("p_size"), "id")], "id")


@query(f"WITH {fx.RAW_SQL}, names AS (SELECT doc_id, name, count(*) AS n FROM ent GROUP BY 1, 2) SELECT name, count(*) AS docs, sum(n)::BIGINT AS mentions FROM names GROUP BY 1")
def entity_lineage_counts(spark: SparkSession, d: str) -> DataFrame:
    names = extract.entities(fx.responses(spark, d)).groupBy("doc_id", "name").agg(F.count("*").alias("n"))
    return names.groupBy("name").agg(F.count("*").alias("docs"), F.sum("n").alias("mentions"))


@query(f"WITH {fx.RAW_SQL}, kept AS (SELECT * FROM ent WHERE doc_id % 2 = 0), a AS (SELECT name, description, min(pos) AS f FROM kept GROUP BY 1, 2), b AS (SELECT name, chunk_id, min(pos) AS f FROM kept GROUP BY 1, 2) SELECT x.name, description, source_id FROM (SELECT name, string_agg(description, '{SEP}' ORDER BY f, description) AS description FROM a GROUP BY 1) x JOIN (SELECT name, string_agg(chunk_id, '{SEP}' ORDER BY f, chunk_id) AS source_id FROM b GROUP BY 1) y USING (name)")
def rebuild_from_chunks(spark: SparkSession, d: str) -> DataFrame:
    texts = fx.responses(spark, d)
    return ingest.rebuild(extract.entities(texts), texts.where("doc_id % 2 = 0").select("chunk_id"))


@query("SELECT CASE WHEN c_custkey % 4 = 0 THEN 'id ' || c_custkey ELSE c_name END AS entity_id, c_mktsegment AS dim1 FROM customer WHERE c_custkey % 4 = 0 OR c_custkey % 3 = 0")
def standardize_entities(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = fx.table(spark, d, "customer").select(F.when(k % 4 == 0, F.concat(F.lit("id "), k.cast("string"))).otherwise("").alias("entity_id"), F.when(k % 3 == 0, F.col("c_name")).alias("entity_name"), F.col("c_mktsegment").alias("dim1"))
    return merge.standardize_entities(rows).select("entity_id", "dim1")


@query("SELECT p_brand AS file_path, 'error-' || md5('part ' || p_brand || '-bad') AS id, 'failed' AS status FROM part GROUP BY 1")
def failed_files(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.table(spark, d, "part").select(F.col("p_brand").alias("file_path")).distinct()
    return rows.select("file_path", text.hashed_id("error-", F.concat(F.lit("part "), "file_path", F.lit("-bad"))).alias("id"), F.lit("failed").alias("status"))


# --- context, reports --------------------------------------------------------------------------------------------------------


@query(
    """WITH e AS (SELECT c_custkey AS id, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rank, (length(c_name) + 10)::BIGINT AS tokens FROM customer),
r AS (SELECT s_suppkey AS id, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS rank, (length(s_name) + 20)::BIGINT AS tokens FROM supplier),
c AS (SELECT doc_id AS id, row_number() OVER (ORDER BY n_chars, doc_id) AS rank, n_chars AS tokens FROM documents),
ke AS (SELECT *, sum(tokens) OVER (ORDER BY rank) AS used FROM e), kr AS (SELECT *, sum(tokens) OVER (ORDER BY rank) AS used FROM r), kc AS (SELECT *, sum(tokens) OVER (ORDER BY rank) AS used FROM c),
u AS (SELECT (SELECT max(used) FROM ke WHERE used <= 600) + (SELECT max(used) FROM kr WHERE used <= 400) AS used)
SELECT 'entities' AS part, id, rank, used::BIGINT AS used FROM ke WHERE used <= 600 UNION ALL SELECT 'relations', id, rank, used::BIGINT FROM kr WHERE used <= 400
UNION ALL SELECT 'chunks', id, rank, kc.used::BIGINT FROM kc, u WHERE rank <= 20 AND kc.used <= 2000 - (100 + u.used + 30 + 200)"""
)
def context_build(spark: SparkSession, d: str) -> DataFrame:
    def ranked(name: str, key: str, tokens, *by) -> DataFrame:
        return fx.table(spark, d, name).select(F.col(key).alias("id"), tokens.cast("bigint").alias("tokens"), F.row_number().over(Window.orderBy(*by)).cast("bigint").alias("rank"))

    e = ranked("customer", "c_custkey", F.char_length("c_name") + 10, F.desc("c_acctbal"), "c_custkey")
    r = ranked("supplier", "s_suppkey", F.char_length("s_name") + 20, F.desc("s_acctbal"), "s_suppkey")
    c = ranked("documents", "doc_id", F.col("n_chars"), F.col("n_chars"), "doc_id")
    p = retrieve.QueryParam(max_entity_tokens=600, max_relation_tokens=400, max_total_tokens=2000, chunk_top_k=20)
    parts = [df.select(F.lit(name).alias("part"), "id", "rank", "used") for name, df in retrieve.context(e, r, c, p, prompt=100, query=30).items()]
    return parts[0].union(parts[1]).union(parts[2])


@query("""SELECT 'entity' AS kind, c_custkey AS rank, '{"entity_name":"' || c_name || '","entity_type":"' || CASE WHEN c_custkey % 3 = 0 THEN 'UNKNOWN' ELSE c_mktsegment END || '"}' AS record FROM customer""")
def client_records(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.table(spark, d, "customer").select(F.col("c_custkey").alias("rank"), "c_name", F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("kind_of"))
    return retrieve.records(rows, "entity", {"entity_name": "c_name", "entity_type": "kind_of"})


@query("WITH a AS (SELECT p_type AS block, count(*) AS n_before, count(DISTINCT p_name) AS n_after FROM part GROUP BY 1) SELECT block, n_before, n_after, round((n_before - n_after) * 100.0::DOUBLE / n_before, 4) AS saved_percent FROM a")
def merge_savings(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.table(spark, d, "part").select(F.col("p_type").alias("block"), "p_name")
    return stats.merge_savings(rows, rows.distinct(), "block")


@query(f"WITH {fx.NODES_SQL}, {fx.EDGES_SQL}, g AS (SELECT a AS entity_id, count(*) AS degree FROM sym GROUP BY 1) SELECT entity_id, degree, round(0.5::DOUBLE + (degree - (SELECT min(degree) FROM g))::DOUBLE / ((SELECT max(degree) FROM g) - (SELECT min(degree) FROM g)) * 1.5::DOUBLE, 6) AS scaled FROM g")
def node_sizes(spark: SparkSession, d: str) -> DataFrame:
    return stats.scaled(graph.degrees(fx.edges(spark, d)), "degree")


@query("SELECT l_returnflag AS key, count(*) AS n, round(avg(l_quantity), 6) AS mean, string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) AS kinds FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1")
def filtered_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return rows.groupBy(F.col("l_returnflag").alias("key")).agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 6).alias("mean"), F.array_join(F.array_sort(F.collect_set("l_linestatus")), ",").alias("kinds"))


# --- records, chunks and tracking --------------------------------------------------------------------------------------------

_LIBRARY = """lib AS (SELECT p_partkey AS pos, p_name, lower(replace(p_brand, ' ', '')) AS kind, p_type, p_size FROM part)"""


def _library_responses(spark: SparkSession, d: str) -> DataFrame:
    """A response for each part: an entity, for some a glued one of a bad type or of a fifth field, and a relation."""
    # a row of a small file grows to a text that takes long to clean
    p = tables.spread(fx.table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size"), "p_partkey", each=50_000)
    key = F.col("p_partkey")
    field = lambda *parts: F.concat_ws(FIELD, *[F.lit(x) if isinstance(x, str) else x for x in parts])
    entity = field("entity", F.col("p_name"), F.col("p_brand"), F.concat(F.lit("size &lt; "), F.col("p_size").cast("string")))
    glued = F.when(key % 5 == 0, F.concat(F.lit(FIELD), field("entity", F.concat(F.lit("glued "), key.cast("string")), "Some Kind", "told"))).when(key % 5 == 1, F.concat(F.lit("\n"), field("entity", "bad", "a/b", "told"))).when(key % 5 == 2, F.concat(F.lit("\n"), field("entity", "long", "kind", "told", "more"))).otherwise("")
    relation = F.concat(F.when(key % 2 == 0, F.lit(FIELD)).otherwise("\n"), field(F.when(key % 4 == 0, "relationship").otherwise("relation"), F.col("p_name"), F.when(key % 7 == 0, F.col("p_name")).otherwise(F.col("p_type")), "IS_A，BASED_ON", F.when(key % 3 == 0, F.lit("'2.5'")).otherwise("is one")), F.lit("<|complete|>"))
    return p.select(key.alias("doc_id"), key.alias("pos"), F.lit("f").alias("file_path"), key.cast("string").alias("chunk_id"), F.concat(entity, glued, relation).alias("response"))


@query(f"WITH {_LIBRARY} SELECT pos, p_name AS name, kind, 'size < ' || p_size AS description FROM lib UNION ALL SELECT pos, 'glued ' || pos, 'somekind', 'told' FROM lib WHERE pos % 5 = 0")
def library_entities(spark: SparkSession, d: str) -> DataFrame:
    return extract.library_records(_library_responses(spark, d))[0].select("pos", "name", "kind", "description")


@query(f"WITH {_LIBRARY} SELECT pos, p_name AS src_name, p_type AS tgt_name, 'IS_A,BASED_ON' AS keywords, CASE WHEN pos % 3 = 0 THEN '' ELSE 'is one' END AS description, CASE WHEN pos % 3 = 0 THEN 2.5 ELSE 1.0 END::DOUBLE AS weight FROM lib WHERE pos % 7 <> 0")
def library_relations(spark: SparkSession, d: str) -> DataFrame:
    rows = extract.library_records(_library_responses(spark, d))[1]
    return rows.select("pos", "src_name", "tgt_name", "keywords", F.when(F.col("weight") == 1.0, F.col("description")).otherwise("").alias("description"), "weight")


@query(
    """WITH parts AS (SELECT doc_id, generate_subscripts(p, 1) AS k, unnest(p) AS part FROM (SELECT doc_id, string_split(text, '. ') AS p FROM documents WHERE text IS NOT NULL)),
w AS (SELECT *, CASE WHEN trim(part, ' ') = '' THEN [] ELSE string_split(trim(part, ' '), ' ') END AS words FROM parts),
cut AS (SELECT doc_id, k, 0 AS start, len(words) AS tokens, trim(part, ' ') AS content FROM w WHERE len(words) <= 12
  UNION ALL SELECT doc_id, k, start, least(12, len(words) - start), trim(array_to_string(words[start + 1:start + 12], ' '), ' ') FROM (SELECT *, unnest(range(0, len(words), 9)) AS start FROM w WHERE len(words) > 12))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k, start) - 1 AS chunk_order_index, tokens::BIGINT AS tokens, content, 'chunk-' || md5(content) AS chunk_id FROM cut"""
)
def chunks_at_marks(spark: SparkSession, d: str) -> DataFrame:
    return extract.windows_at(fx.table(spark, d, "documents"), ". ", 12, 3)


@query(f"""WITH {fx.EDGES_SQL}, own AS (SELECT 'c:' || c_custkey AS key, 'k' || c_custkey % 9 || '{SEP} {SEP}k' || c_custkey % 4 AS s FROM customer),
e AS (SELECT least(src_id, tgt_id) || '{SEP}' || greatest(src_id, tgt_id) AS key, keywords || '{SEP}' || weight AS s, edge_id FROM edges),
x AS (SELECT 'entity' AS kind, key, '' AS edge_id, generate_subscripts(string_split(s, '{SEP}'), 1) AS i, trim(unnest(string_split(s, '{SEP}'))) AS c FROM own UNION ALL SELECT 'relation', key, edge_id, generate_subscripts(string_split(s, '{SEP}'), 1), trim(unnest(string_split(s, '{SEP}'))) FROM e),
once AS (SELECT kind, key, c, min((edge_id, i)) AS f FROM x WHERE c <> '' GROUP BY ALL) SELECT kind, key, string_agg(c, ',' ORDER BY f) AS chunks, count(*) AS n FROM once GROUP BY 1, 2""")
def chunk_tracking(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    part = lambda n: F.concat(F.lit("k"), (k % n).cast("string"))
    nodes = fx.table(spark, d, "customer").select(F.concat(F.lit("c:"), k.cast("string")).alias("entity_id"), F.concat_ws(SEP, part(9), F.lit(" "), part(4)).alias("source_id"))
    edges = fx.edges(spark, d).withColumn("source_id", F.concat_ws(SEP, "keywords", F.col("weight").cast("string")))
    return maintain.chunk_tracking(nodes, edges).select("kind", "key", F.array_join("chunk_ids", ",").alias("chunks"), "n")


@query("SELECT o_custkey::VARCHAR AS chunk_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey::VARCHAR) AS place, o_orderkey::VARCHAR AS key, o_orderpriority AS response FROM orders WHERE o_orderstatus = 'F'")
def cached_results(spark: SparkSession, d: str) -> DataFrame:
    o = fx.table(spark, d, "orders")
    key = F.col("o_orderkey").cast("string")
    chunks = o.groupBy(F.col("o_custkey").cast("string").alias("chunk_id")).agg(F.concat(F.collect_list(key), F.array(F.lit("none"))).alias("llm_cache_list"))
    cache = o.select(key.alias("key"), F.when(F.col("o_orderstatus") == "F", "extract").otherwise("summary").alias("cache_type"), F.col("o_orderpriority").alias("response"), F.col("o_orderdate").alias("created_at"))
    return maintain.cached_results(chunks, cache)


@query("SELECT doc_id, 'a < b & ' || n_chars || ' é' AS clean, 'x😀y' || n_chars || 'é\\u12' AS decoded, strftime(make_timestamp(n_chars * 1000000), '%Y-%m-%d %H:%M:%S') AS at FROM documents")
def text_decoding(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_chars").cast("string")
    return fx.table(spark, d, "documents").select(
        "doc_id", text.sanitized(F.concat(F.lit(" a &lt; b\x07 &amp; "), n, F.lit(" &eacute;&#x9;\n"))).alias("clean"),
        text.decode_escapes(F.concat(F.lit("x\\ud83d\\ude00y"), n, F.lit("\\u00E9\\u12"))).alias("decoded"), text.local_time(F.col("n_chars")).alias("at"),
    )


@query(f"WITH {fx.EDGES_SQL} SELECT edge_id, least(src_id, tgt_id) AS src_id, greatest(src_id, tgt_id) AS tgt_id FROM edges WHERE NOT (keywords = 'SUPPLIES' AND weight = 1)")
def delete_relations(spark: SparkSession, d: str) -> DataFrame:
    edges = fx.edges(spark, d)
    gone = edges.where("keywords = 'SUPPLIES' and weight = 1").select(F.col("tgt_id").alias("src_id"), F.col("src_id").alias("tgt_id"))
    left = maintain.delete_relations(edges, gone)
    pair = text.parse_pair_key(text.pair_key(F.col("src_id"), F.col("tgt_id")))
    return left.select("edge_id", pair["src_id"].alias("src_id"), pair["tgt_id"].alias("tgt_id"))
