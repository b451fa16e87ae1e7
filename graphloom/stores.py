"""Named tables in a folder: key-value, vectors, graph and document status, each a Parquet snapshot per version and workspace."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import graph, maintain, merge, vector
from graphloom.sources import tables


class Store:
    """One table under root/workspace/name. A change writes the next version beside the last one and then drops older ones but one,
    so that readers of the last version aren't disturbed."""

    def __init__(self, spark: SparkSession, root: str, name: str, schema: str, key: str, workspace: str = "default") -> None:
        self.spark, self.key, self.schema = spark, key, schema
        self.path = f"{root}/{workspace}/{name}"

    def _fs(self):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def versions(self) -> list[int]:
        fs, at = self._fs()
        if not fs.exists(at):
            return []
        done = self.spark._jvm.org.apache.hadoop.fs.Path
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        return sorted(int(n[1:]) for n in names if n.startswith("v") and fs.exists(done(f"{self.path}/{n}/_SUCCESS")))

    def read(self) -> DataFrame:
        found = self.versions()
        if not found:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.parquet(f"{self.path}/v{found[-1]}")

    def write(self, df: DataFrame) -> None:
        found = self.versions()
        number = (found[-1] if found else 0) + 1
        df.write.mode("overwrite").parquet(f"{self.path}/v{number}")
        fs, _ = self._fs()
        for old in found[:-1]:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v{old}"), True)

    def is_empty(self) -> bool:
        return self.read().isEmpty()

    def drop(self) -> None:
        fs, at = self._fs()
        fs.delete(at, True)

    def upsert(self, new: DataFrame) -> None:
        self.write(tables.upsert(self.read(), new, [self.key]))

    def delete(self, keys: DataFrame) -> None:
        self.write(tables.delete_keys(self.read(), keys, self.key))

    def get_many(self, wanted: DataFrame) -> DataFrame:
        """wanted(pos, key) with the stored columns, null where there is nothing."""
        return tables.get_many(self.read(), wanted, self.key)

    def new_keys(self, wanted: DataFrame) -> DataFrame:
        return tables.new_keys(wanted, self.read(), self.key)


class VectorStore(Store):
    def __init__(self, spark: SparkSession, root: str, name: str, workspace: str = "default") -> None:
        super().__init__(spark, root, name, "id string, block string, content string, embedding array<float>", "id", workspace)

    def query(self, embedding: list[float], k: int, threshold: float | None = None) -> DataFrame:
        return vector.top_k(self.read(), embedding, k, threshold)


class GraphStore:
    """nodes(entity_id, dim1, dim2, description, source_id) and edges(edge_id, src_id, tgt_id, keywords, description, weight, source_id)."""

    def __init__(self, spark: SparkSession, root: str, workspace: str = "default") -> None:
        self.nodes = Store(spark, root, "nodes", "entity_id string, dim1 string, dim2 string, description string, source_id string", "entity_id", workspace)
        self.edges = Store(spark, root, "edges", "edge_id string, src_id string, tgt_id string, keywords string, description string, weight double, source_id string", "edge_id", workspace)

    def has_node(self, entity_id: str) -> bool:
        return not self.nodes.read().where(F.col("entity_id") == entity_id).isEmpty()

    def has_edge(self, a: str, b: str) -> bool:
        e = self.edges.read()
        return not e.where(((F.col("src_id") == a) & (F.col("tgt_id") == b)) | ((F.col("src_id") == b) & (F.col("tgt_id") == a))).isEmpty()

    def degrees(self) -> DataFrame:
        return graph.degrees(self.edges.read(), self.nodes.read())

    def neighbours(self, ids: DataFrame, direction: str = "both") -> DataFrame:
        return graph.neighbours(self.edges.read(), self.nodes.read(), ids, direction)

    def subgraph(self, seed: str, depth: int = 3, max_nodes: int = 1000) -> tuple[DataFrame, DataFrame, bool]:
        """(nodes with level, edges, truncated); '*' takes the best linked nodes."""
        edges, nodes = self.edges.read(), self.nodes.read()
        if seed == "*":
            ids = graph.top_by_degree(edges, nodes, max_nodes).select("entity_id", F.lit(0).cast("bigint").alias("level"))
            cut = nodes.count() > max_nodes
        else:
            ids, cut = graph.breadth_first(edges, seed, depth, min(max_nodes, 1000))
        return nodes.join(ids, "entity_id"), graph.induced(edges, ids.select("entity_id")), cut

    def delete_nodes(self, gone: DataFrame) -> None:
        nodes, edges = maintain.delete_nodes(self.nodes.read(), self.edges.read(), gone)
        self.nodes.write(nodes)
        self.edges.write(edges)

    def rename(self, old: str, new: str) -> None:
        nodes, edges = maintain.rename(self.nodes.read(), self.edges.read(), old, new)
        self.nodes.write(nodes)
        self.edges.write(edges)

    def create_node(self, row: DataFrame) -> None:
        entity_id = row.select("entity_id").first()[0]
        if self.has_node(entity_id):
            raise ValueError(f"{entity_id!r} exists")
        self.nodes.upsert(row)

    def create_edge(self, row: DataFrame) -> None:
        one = row.first()
        for end in (one.src_id, one.tgt_id):
            if not self.has_node(end):
                raise ValueError(f"no node {end!r}")
        if self.has_edge(one.src_id, one.tgt_id):
            raise ValueError("the edge exists")
        self.edges.upsert(row)

    def merge_into(self, sources: DataFrame, target: str) -> None:
        """Nodes of sources(entity_id) as target: attributes merge, their edges move, self-links among them go; all else stays."""
        nodes, edges = merge.merge_nodes(self.nodes.read(), self.edges.read(), sources, target)
        nodes, edges = tables.materialized(nodes), tables.materialized(edges)
        self.nodes.write(nodes)
        self.edges.write(edges)


class ResultStore:
    """What an extraction found: entities, relations and chunks."""

    def __init__(self, spark: SparkSession, root: str, workspace: str = "default") -> None:
        self.entities = Store(spark, root, "found_entities", "entity_id string, entity_name string, dim1 string, dim2 string, description string, source_id string, file_path string", "entity_id", workspace)
        self.relations = Store(spark, root, "found_relations", "src_id string, tgt_id string, keywords string, description string, weight double, source_id string, file_path string", "src_id", workspace)
        self.chunks = Store(spark, root, "found_chunks", "chunk_id string, content string, tokens bigint, chunk_order_index bigint, full_doc_id string, file_path string", "chunk_id", workspace)

    def write(self, entities: DataFrame, relations: DataFrame, chunks: DataFrame | None = None, append: bool = False) -> None:
        """Replace what is stored, or append to it: stored entities (by id) and relations (by both ends) stay as they are, new
        chunks replace stored ones. Without chunks theirs stay."""
        if append:
            old = self.entities.read()
            entities = old.unionByName(entities.join(old.select("entity_id"), "entity_id", "left_anti"), allowMissingColumns=True)
            old = self.relations.read()
            relations = old.unionByName(relations.join(old.select("src_id", "tgt_id").distinct(), ["src_id", "tgt_id"], "left_anti"), allowMissingColumns=True)
        self.entities.write(entities)
        self.relations.write(relations)
        if chunks is not None:
            self.chunks.upsert(chunks) if append else self.chunks.write(chunks)


class StatusStore(Store):
    def __init__(self, spark: SparkSession, root: str, workspace: str = "default") -> None:
        super().__init__(spark, root, "doc_status", "id string, status string, content_summary string, content_length bigint, file_path string, created_at timestamp, updated_at timestamp, track_id string, chunks_list array<string>, error_msg string, metadata map<string,string>", "id", workspace)

    def counts(self) -> DataFrame:
        return maintain.status_counts(self.read())

    def by_status(self, *statuses: str) -> DataFrame:
        return self.read().where(F.col("status").isin(*statuses)).withColumns({"file_path": F.coalesce("file_path", F.lit("no-file-path")), "metadata": F.coalesce("metadata", F.create_map().cast("map<string,string>"))})

    def by_track(self, track_id: str) -> DataFrame:
        return self.read().where(F.col("track_id") == track_id)

    def by_path(self, file_path: str) -> DataFrame:
        return self.read().where(F.col("file_path") == file_path).orderBy("id").limit(1)

    def page(self, number: int = 1, size: int = 50, by: str = "updated_at", descending: bool = True) -> DataFrame:
        if by not in ("created_at", "updated_at", "id", "file_path"):
            by = "updated_at"
        return maintain.page(self.read(), number, size, by, "id", descending)

    def move(self, changes: DataFrame) -> None:
        """changes(id, status, updated_at): the latest of each id wins."""
        now = maintain.move(self.read().select("id", "status", "updated_at"), changes)
        rest = self.read().drop("status", "updated_at")
        self.write(now.join(rest, "id", "left").select(*self.read().columns))
