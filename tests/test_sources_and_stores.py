import json

import pytest

from graphloom.operators import merge
from graphloom.api import KnowledgeGraph, read_only
from graphloom.schema import SEP
from graphloom.sources import readers
from graphloom.stores import GraphStore, StatusStore, Store, VectorStore


def test_readers(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.md").write_text("one\ntwo")
    (tmp_path / "a" / "blank.txt").write_text("  ")
    (tmp_path / "a" / "skip.bin").write_text("no")
    (tmp_path / "y.jsonl").write_text('{"a": 1}\nbroken\n\n[1]\n')
    (tmp_path / "z.txt").write_bytes("图论".encode("gbk"))
    got = {r.file_path.rsplit("/", 1)[1]: r.text for r in readers.documents(spark, str(tmp_path)).collect()}
    assert got == {"x.md": "one\ntwo", "y.jsonl": '{"a": 1}\nbroken\n\n[1]\n', "z.txt": "图论"}
    assert [r.text for r in readers.documents(spark, str(tmp_path / "y.jsonl")).collect()] == ['{"a": 1}', "[1]"]
    with pytest.raises(FileNotFoundError):
        readers.documents(spark, str(tmp_path / "none"))
    (tmp_path / "chunks.json").write_text(json.dumps({"c1": {"content": "t", "tokens": 3}, "c2": {"chunk_id": "cc", "content": "u"}}))
    assert {(r.chunk_id, r.tokens) for r in readers.chunk_map(spark, str(tmp_path / "chunks.json")).collect()} == {("c1", 3), ("cc", None)}


@pytest.mark.parametrize("kind", ["csv", "json", "parquet", "md", "txt"])
def test_export(spark, tmp_path, kind):
    readers.export(spark.createDataFrame([(1, "a|b")], "i int, s string"), str(tmp_path / kind), kind)
    if kind in ("md", "txt"):
        assert spark.read.text(str(tmp_path / kind)).first()[0] == ("| 1 | a\\|b |" if kind == "md" else "1\ta|b")
    else:
        assert spark.read.format(kind).options(header=True).load(str(tmp_path / kind)).count() == 1


def test_stores(spark, tmp_path):
    kv = Store(spark, str(tmp_path), "kv", "key string, v long", "key")
    assert kv.is_empty()
    kv.upsert(spark.createDataFrame([("a", 1), ("b", 2)], "key string, v long"))
    kv.upsert(spark.createDataFrame([("b", 3), ("c", 4)], "key string, v long"))
    kv.delete(spark.createDataFrame([("a",)], "key string"))
    assert {(r.key, r.v) for r in kv.read().collect()} == {("b", 3), ("c", 4)} and len(kv.versions()) == 2
    assert [r.key for r in kv.new_keys(spark.createDataFrame([("b",), ("z",)], "key string")).collect()] == ["z"]
    kv.drop()
    assert kv.is_empty()
    vec = VectorStore(spark, str(tmp_path), "vec")
    vec.upsert(spark.createDataFrame([("x", "b", "t", [1.0, 0.0]), ("y", "b", "t", [0.0, 1.0])], "id string, block string, content string, embedding array<float>"))
    assert [r.id for r in vec.query([1.0, 0.1], 5, 0.5).collect()] == ["x"]
    status = StatusStore(spark, str(tmp_path))
    assert {r.status: r.n for r in status.counts().collect()}["all"] == 0


NODE = "entity_id string, dim1 string, dim2 string, description string, source_id string"
EDGE = "edge_id string, src_id string, tgt_id string, keywords string, description string, weight double, source_id string"


def small_graph(spark, root):
    kg = KnowledgeGraph(spark, root, embed=lambda text: [1.0, float(len(text))])
    kg.graph.nodes.upsert(spark.createDataFrame([("a", "t", "u", "first", "c1"), ("b", "t", "u", "second", f"c1{SEP}c2"), ("c", "t", "u", "third", "c2")], NODE))
    kg.graph.edges.upsert(spark.createDataFrame([("e1", "a", "b", "IS_A", "", 1.0, "c1"), ("e2", "b", "c", "IS_A", "", 2.0, "c2"), ("e3", "a", "c", "IS_A", "", 3.0, "c2")], EDGE))
    kg.chunks_table.upsert(spark.createDataFrame([("c1", "text one", 2, 0, "doc-1", "f"), ("c2", "text two", 2, 0, "doc-2", "g")], "chunk_id string, content string, tokens bigint, chunk_order_index bigint, full_doc_id string, file_path string"))
    vec = [("a", "t", "", [1.0, 1.0]), ("b", "t", "", [1.0, 5.0]), ("c", "t", "", [1.0, -5.0])]
    kg.vectors.upsert(spark.createDataFrame(vec, "id string, block string, content string, embedding array<float>"))
    return kg


def test_graph_api(spark, tmp_path):
    kg = small_graph(spark, str(tmp_path))
    assert [r.id for r in kg.find_entities("hello", 1).collect()] == ["b"]
    assert {r.id for r in kg.find_entities("hello", 2, rerank="degree").collect()} <= {"a", "b", "c"}
    assert [r.n for r in kg.sql("SELECT count(*) AS n FROM edges_sym WHERE a = :x", x="b").collect()] == [2]
    assert {(r.chunk_id, r.status) for r in kg.chunks("b").collect()} == {("c1", "available"), ("c2", "available")}
    assert kg.graph.has_edge("b", "a") and not kg.graph.has_node("z")
    assert kg.retrieve("hello")["entities"].count() > 0
    nodes, edges, cut = kg.graph.subgraph("a", 1)
    assert nodes.count() == 3 and edges.count() == 3 and not cut
    impact = {(r.key, r.action, r.remaining) for r in kg.delete_document("doc-1").collect()}
    assert impact == {("a", "delete", ""), ("b", "rebuild", "c2")}
    assert {r.entity_id: r.source_id for r in kg.graph.nodes.read().collect()} == {"b": "c2", "c": "c2"}
    assert [r.edge_id for r in kg.graph.edges.read().collect()] == ["e2"] and kg.chunks_table.read().count() == 1


def test_graph_edits(spark, tmp_path):
    g: GraphStore = small_graph(spark, str(tmp_path)).graph
    with pytest.raises(ValueError):
        g.create_node(spark.createDataFrame([("a", "", "", "", "")], NODE))
    with pytest.raises(ValueError):
        g.create_edge(spark.createDataFrame([("e9", "a", "zz", "", "", 1.0, "")], EDGE))
    g.rename("a", "alpha")
    assert g.has_edge("alpha", "b")
    g.merge_into(spark.createDataFrame([("alpha",), ("b",)], "entity_id string"), "b")
    assert {(r.src_id, r.tgt_id, r.weight) for r in g.edges.read().collect()} == {("b", "c", 3.0)} and g.nodes.read().count() == 2
    g.delete_nodes(spark.createDataFrame([("b",)], "entity_id string"))
    assert g.edges.is_empty() and g.nodes.read().count() == 1


@pytest.mark.parametrize("sql", ["DROP TABLE x", "CREATE TABLE t AS SELECT 1", "INSERT INTO t SELECT 1", "CREATE VIEW v AS SELECT 1", "SET a = 1", "DELETE FROM t"])
def test_writing_sql_is_refused(spark, sql):
    with pytest.raises(ValueError):
        read_only(spark, sql)


def test_reading_sql_may_name_commands(spark):
    read_only(spark, "SELECT 'DROP TABLE x' AS delete FROM nodes WHERE set = 'create'")


def test_merging_leaves_other_edges_alone(spark):
    nodes = spark.createDataFrame([("a", "t", "x", "first", "c1"), ("b", "u", "y", "second", "c2<SEP>c1"), ("c", "t", "", "third", "c3"), ("d", "t", "", "", "c4")], NODE)
    edges = spark.createDataFrame(
        [("e1", "c", "d", "k", "one", 1.0, "c1"), ("e2", "c", "d", "l", "two", 2.0, "c2"), ("e3", "d", "c", "m", "back", 3.0, "c3"), ("e4", "a", "b", "k", "self", 1.0, "c1"), ("e5", "a", "c", "k1", "ac", 1.0, "c1"), ("e6", "c", "b", "k2", "cb", 5.0, "c2"), ("e7", "b", "d", "k", "bd", 1.0, "c2")],
        EDGE,
    )
    sources = spark.createDataFrame([("a",), ("b",), ("nowhere",)], "entity_id string")
    got_nodes, got_edges = merge.merge_nodes(nodes, edges, sources, "b")
    assert {(r.entity_id, r.dim1, r.dim2, r.description, r.source_id) for r in got_nodes.collect()} == {("b", "u", "x,y", "second<SEP>first", "c1<SEP>c2"), ("c", "t", "", "third", "c3"), ("d", "t", "", "", "c4")}
    found = {r.edge_id: (r.src_id, r.tgt_id, r.keywords, r.description, r.weight, r.source_id) for r in got_edges.collect()}
    assert found == {
        "e1": ("c", "d", "k", "one", 1.0, "c1"), "e2": ("c", "d", "l", "two", 2.0, "c2"), "e3": ("d", "c", "m", "back", 3.0, "c3"), "e7": ("b", "d", "k", "bd", 1.0, "c2"), "e6": ("c", "b", "k1,k2", "cb<SEP>ac", 5.0, "c1<SEP>c2"),
    }


def test_a_target_that_is_no_node_becomes_one(spark):
    nodes = spark.createDataFrame([("a", "t", "x", "first", "c1"), ("b", "t", "y", "second", "c2")], NODE)
    edges = spark.createDataFrame([("e1", "a", "b", "k", "", 1.0, "c1")], EDGE)
    got_nodes, got_edges = merge.merge_nodes(nodes, edges, nodes.select("entity_id"), "new")
    assert [(r.entity_id, r.description) for r in got_nodes.collect()] == [("new", "first<SEP>second")] and got_edges.count() == 0


def test_a_new_stream_goes_on_from_the_table(spark, tmp_path):
    from graphloom.streaming import append

    for k, rows in enumerate(([{"id": "1", "text": "a"}], [{"id": "2", "text": "b"}, {"id": "1", "text": "c"}])):
        folder = tmp_path / f"in{k}"
        folder.mkdir()
        (folder / "x.json").write_text("\n".join(json.dumps(r) for r in rows))
        for _ in range(2):  # run again with the same checkpoint: nothing new
            append.append_to_table(append.stream_documents(spark, str(folder), "id string, text string"), str(tmp_path / "t"), ["id"], str(tmp_path / f"check{k}")).awaitTermination()
    assert {(r.id, r.text) for r in append.read_table(spark, str(tmp_path / "t")).collect()} == {("1", "c"), ("2", "b")}


def test_a_deleted_document_leaves_no_trace(spark, tmp_path):
    kg = small_graph(spark, str(tmp_path))
    kg.vectors.upsert(spark.createDataFrame([("a", "t", "", [1.0]), ("b", "t", "", [1.0])], "id string, block string, content string, embedding array<float>"))
    kg.delete_document("doc-1")
    assert "a" not in {r.id for r in kg.vectors.read().collect()}
    named = {x for rows in (kg.graph.nodes.read(), kg.graph.edges.read()) for r in rows.collect() for x in r.source_id.split("<SEP>")}
    assert "c1" not in named
