"""Graphs, vectors, chunks and extraction texts derived from the driver's tables; each in DataFrames and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.schema import FIELD
from graphloom.sources.tables import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(prefix: str, key: str):
    return F.concat(F.lit(f"{prefix}:"), F.col(key).cast("string"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity_id, dim1, dim2, description) of customers, parts, suppliers, nations and regions."""
    t = lambda n: table(spark, sf_dir, n)
    rows = [
        t("customer").select(_id("c", "c_custkey").alias("entity_id"), F.lit("customer").alias("dim1"), F.col("c_mktsegment").alias("dim2"), F.col("c_name").alias("description")),
        t("part").select(_id("p", "p_partkey"), F.lit("part"), "p_brand", "p_name"),
        t("supplier").select(_id("s", "s_suppkey"), F.lit("supplier"), F.concat(F.lit("nation "), F.col("s_nationkey").cast("string")), "s_name"),
        t("nation").select(_id("n", "n_nationkey"), F.lit("nation"), F.concat(F.lit("region "), F.col("n_regionkey").cast("string")), "n_name"),
        t("region").select(_id("r", "r_regionkey"), F.lit("region"), F.lit("root"), "r_name"),
    ]
    out = rows[0]
    for more in rows[1:]:
        out = out.union(more)
    return out


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(edge_id, src_id, tgt_id, keywords, weight): purchases, supplies, and places."""
    t = lambda n: table(spark, sf_dir, n)
    items = t("lineitem")
    bought = items.join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy(_id("c", "o_custkey").alias("src_id"), _id("p", "l_partkey").alias("tgt_id")).agg(F.lit("BUYS").alias("keywords"), F.count("*").alias("weight"))
    supplied = items.groupBy(_id("s", "l_suppkey").alias("src_id"), _id("p", "l_partkey").alias("tgt_id")).agg(F.lit("SUPPLIES").alias("keywords"), F.count("*").alias("weight"))
    return with_edge_id(bought.union(supplied).union(places(spark, sf_dir).drop("edge_id")))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges from customers, suppliers and nations to where they are."""
    t = lambda n: table(spark, sf_dir, n)
    one = F.lit(1).cast("bigint").alias("weight")
    rows = t("customer").select(_id("c", "c_custkey").alias("src_id"), _id("n", "c_nationkey").alias("tgt_id"), F.lit("IN_NATION").alias("keywords"), one)
    rows = rows.union(t("supplier").select(_id("s", "s_suppkey"), _id("n", "s_nationkey"), F.lit("IN_NATION"), one))
    return with_edge_id(rows.union(t("nation").select(_id("n", "n_nationkey"), _id("r", "n_regionkey"), F.lit("IN_REGION"), one)))


def with_edge_id(rows: DataFrame) -> DataFrame:
    return rows.select(F.concat_ws("|", "keywords", "src_id", "tgt_id").alias("edge_id"), "src_id", "tgt_id", "keywords", "weight")


NODES_SQL = """nodes AS (
  SELECT 'c:' || c_custkey AS entity_id, 'customer' AS dim1, c_mktsegment AS dim2, c_name AS description FROM customer
  UNION ALL SELECT 'p:' || p_partkey, 'part', p_brand, p_name FROM part
  UNION ALL SELECT 's:' || s_suppkey, 'supplier', 'nation ' || s_nationkey, s_name FROM supplier
  UNION ALL SELECT 'n:' || n_nationkey, 'nation', 'region ' || n_regionkey, n_name FROM nation
  UNION ALL SELECT 'r:' || r_regionkey, 'region', 'root', r_name FROM region)"""
PLACES_SQL = """places AS (
  SELECT keywords || '|' || src_id || '|' || tgt_id AS edge_id, * FROM (
    SELECT 'c:' || c_custkey AS src_id, 'n:' || c_nationkey AS tgt_id, 'IN_NATION' AS keywords, 1::BIGINT AS weight FROM customer
    UNION ALL SELECT 's:' || s_suppkey, 'n:' || s_nationkey, 'IN_NATION', 1 FROM supplier
    UNION ALL SELECT 'n:' || n_nationkey, 'r:' || n_regionkey, 'IN_REGION', 1 FROM nation))"""
EDGES_SQL = f"""{PLACES_SQL}, edges AS (
  SELECT keywords || '|' || src_id || '|' || tgt_id AS edge_id, * FROM (
    SELECT 'c:' || o_custkey AS src_id, 'p:' || l_partkey AS tgt_id, 'BUYS' AS keywords, count(*)::BIGINT AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2
    UNION ALL SELECT 's:' || l_suppkey, 'p:' || l_partkey, 'SUPPLIES', count(*)::BIGINT FROM lineitem GROUP BY 1, 2)
  UNION ALL SELECT * FROM places),
sym AS (SELECT edge_id, src_id AS a, tgt_id AS b, keywords, weight FROM edges UNION ALL SELECT edge_id, tgt_id, src_id, keywords, weight FROM edges)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, block, embedding)"""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("block"), "embedding")


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The vector of row 0: one row."""
    return list(table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()[0])


VECTORS_SQL = """vecs AS (SELECT vec_id AS id, label::VARCHAR AS block, embedding::DOUBLE[] AS e FROM embeddings),
hits AS (SELECT id, block, round(list_cosine_similarity(e, (SELECT e FROM vecs WHERE id = 0)), 4) AS score FROM vecs)"""
#: Five nearest of the same block by rounded cosine, smaller id first.
KNN_SQL = f"""{VECTORS_SQL}, near AS (
  SELECT id AS src, other AS tgt, score FROM (
    SELECT a.id, b.id AS other, round(list_cosine_similarity(a.e, b.e), 4) AS score,
      row_number() OVER (PARTITION BY a.id ORDER BY round(list_cosine_similarity(a.e, b.e), 4) DESC, b.id) AS rank
    FROM vecs a JOIN vecs b ON a.block = b.block AND a.id <> b.id) WHERE rank <= 5),
links AS (SELECT least(src, tgt) AS a, greatest(src, tgt) AS b, max(score) AS weight FROM near GROUP BY 1, 2),
degrees AS (SELECT id, coalesce(d, 0)::BIGINT AS degree FROM vecs LEFT JOIN (SELECT x, count(*) AS d FROM (SELECT a AS x FROM links UNION ALL SELECT b FROM links) GROUP BY x) ON x = id)"""


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, pos, file_path, chunk_id, response): for each supplier a document; for each of its parts
    a chunk whose response names the part, the supplier and how they relate."""
    t = lambda n: table(spark, sf_dir, n)
    # dealt by part before repeats go and parts are joined: one shuffle for both, and a pair grows to a text behind it
    pairs = spread(t("lineitem").select("l_suppkey", "l_partkey"), "l_partkey").distinct()
    rows = pairs.join(t("part"), F.col("l_partkey") == F.col("p_partkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    field = lambda *parts: F.concat_ws(FIELD, *parts)
    doc, part = F.col("l_suppkey").cast("string"), F.col("l_partkey").cast("string")
    text = F.concat_ws(
        "\n",
        field(F.lit("entity"), F.col("p_name"), F.col("p_brand"), F.col("p_type"), F.concat(F.lit("part "), part)),
        field(F.lit("entity"), F.col("s_name"), F.lit("supplier"), F.concat(F.lit("nation "), F.col("s_nationkey").cast("string")), F.concat(F.lit("supplier of "), F.col("p_brand"))),
        field(F.lit("relation"), F.col("s_name"), F.col("p_name"), F.lit("SUPPLIES,APPLIES_TO"), F.concat(F.lit("offers "), part)),
        F.concat(field(F.lit("relation"), F.col("p_name"), F.col("p_brand"), F.lit("IS_A"), F.lit("is of this brand")), F.lit("<|COMPLETE|>")),
    )
    return rows.select(F.col("l_suppkey").alias("doc_id"), F.col("l_partkey").alias("pos"), F.concat(F.lit("doc-"), doc).alias("file_path"), F.concat(F.lit("chunk-"), doc, F.lit("-"), part).alias("chunk_id"), text.alias("response"))


RAW_SQL = """raw AS (
  SELECT l_suppkey AS doc_id, l_partkey AS pos, 'doc-' || l_suppkey AS file_path, 'chunk-' || l_suppkey || '-' || l_partkey AS chunk_id, p.*, s.*
  FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) JOIN part p ON p_partkey = l_partkey JOIN supplier s ON s_suppkey = l_suppkey),
ent AS (
  SELECT doc_id, pos, 1 AS ord, file_path, chunk_id, p_name AS name, p_brand AS dim1, p_type AS dim2, 'part ' || pos AS description FROM raw
  UNION ALL SELECT doc_id, pos, 2, file_path, chunk_id, s_name, 'supplier', 'nation ' || s_nationkey, 'supplier of ' || p_brand FROM raw),
rel AS (
  SELECT doc_id, pos, 1 AS ord, file_path, chunk_id, s_name AS src_name, p_name AS tgt_name, 'SUPPLIES,APPLIES_TO' AS keywords, 'offers ' || pos AS description FROM raw
  UNION ALL SELECT doc_id, pos, 2, file_path, chunk_id, p_name, p_brand, 'IS_A', 'is of this brand' FROM raw)"""
