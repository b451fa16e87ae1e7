"""Names, escapes, chunk marks, result files, edits and evaluation."""

import json
import math

import pytest
from pyspark.sql import functions as F

from graphloom.functions import lists, text
from graphloom.functions.vectors import encode_float32
from graphloom.operators import evaluate, extract
from graphloom.schema import SEP
from graphloom.sources import readers
from graphloom.stores import ResultStore
from tests.test_sources_and_stores import small_graph


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v"))).first()[0]


def test_texts(spark):
    cases = {"a\\u4e2d\\u6587b": "a中文b", "\\ud83d\\ude00": "😀", "\\u12": "\\u12", "": "", "plain": "plain", "\\u0041": "A", "x\\u0041\\u0042": "xAB"}
    for raw, want in cases.items():
        assert one(spark, text.decode_escapes, raw) == want
    assert one(spark, text.decode_escapes, None) is None and one(spark, text.sanitized, None) is None
    assert one(spark, text.sanitized, "\x00 a&lt;b&#133;&nbsp;") == "a<b…"
    assert one(spark, text.parse_pair_key, f"a{SEP}b").asDict() == {"src_id": "a", "tgt_id": "b"} and one(spark, text.parse_pair_key, "a") is None
    ids = [str(i) for i in range(5)]
    assert [one(spark, lambda c, m=m: lists.cap_by(c, 2, m), ids, "array<string>") for m in ("KEEP", "keep ", "FIFO", None, "other")] == [["0", "1"]] * 2 + [["3", "4"]] * 3
    tracks = [r[0] for r in spark.range(3).select(text.track_id("insert")).collect()]
    assert len(set(tracks)) == 3 and all(t.startswith("insert_") and len(t.split("_")) == 4 for t in tracks)
    names = spark.createDataFrame([("图",), ("Beta",), ("阿",), ("alpha",)], "v string")
    assert [r.v for r in names.orderBy(text.name_order(F.col("v"))).collect()][-2:] == ["阿", "图"] or [r.v for r in names.orderBy(text.name_order(F.col("v"))).collect()][:2] == ["阿", "图"]


def test_records_of_a_response(spark):
    lines = ["entity<|#|>  Dijkstra <|#|>Algo rithm<|#|>finds paths", "entity<|#|>x<|#|>a(b)<|#|>d", "entity<|#|><|#|>t<|#|>d", "entity<|#>Heap<|#|>Structure<|#|>a tree", "relation<|#|>A<|#|>A<|#|>k<|#|>d", "relation<|#|>A<|#|>B<|#|>k，l<|#|>'-.5'", "noise", "relation<|#|>A<|#|>C<|#|>k", f"entity<|#|>{'n' * 300}<|#|>t<|#|>d<|COMPLETE|>"]
    rows = spark.createDataFrame([(1, 0, "f", "c", "\n".join(lines)), (2, 0, "f", "d", None), (3, 0, "f", "e", "")], "doc_id long, pos int, file_path string, chunk_id string, response string")
    entities, relations = extract.library_records(rows)
    assert [(r.name, r.kind, r.description) for r in entities.orderBy("ord").collect()] == [("Dijkstra", "algorithm", "finds paths"), ("Heap", "structure", "a tree"), ("n" * 256, "t", "d")]
    assert [(r.src_name, r.tgt_name, r.keywords, r.weight) for r in relations.collect()] == [("A", "B", "k,l", -0.5)]


def plain_chunks(content, mark, size, overlap, only, split):
    out = []
    for part in content.split(mark):
        words = split(part)
        if only or len(words) <= size:
            out.append((len(words), part.strip(" ")))
        else:
            out += [(min(size, len(words) - s), "".join(words[s : s + size]).strip(" ")) for s in range(0, len(words), size - overlap)]
    return out


@pytest.mark.parametrize("only", [False, True])
def test_chunks_at_marks_with_a_tokenizer(spark, only):
    pieces = lambda t: [t[i : i + 3] for i in range(0, len(t), 3)]
    texts = ["abcdefghij||kl||" + "xyz " * 20, "", "||", "no mark", "m" * 100]
    docs = spark.createDataFrame([*enumerate(texts), (9, None)], "doc_id long, text string")
    got = extract.windows_at(docs, "||", 4, 1, only, tokenize=extract.tokens_by(pieces), glue="").orderBy("doc_id", "chunk_order_index").collect()
    want = [(i, k, *c) for i, t in enumerate(texts) for k, c in enumerate(plain_chunks(t, "||", 4, 1, only, pieces))]
    assert [(r.doc_id, r.chunk_order_index, r.tokens, r.content) for r in got] == want


def test_result_files(spark, tmp_path):
    vector = spark.createDataFrame([([1.0, 2.5],)], "v array<float>").select(encode_float32("v")).first()[0]
    (tmp_path / "entities.json").write_text(json.dumps([{"entity_id": "a", "dim1": "t", "embedding": vector}, {"entity_id": "b"}]))
    (tmp_path / "relations.json").write_text(json.dumps([{"src_id": "a", "tgt_id": "b", "weight": 2}]))
    (tmp_path / "chunks.json").write_text(json.dumps([{"chunk_id": "c1", "content": "t"}, {"content": "u"}]))
    found = readers.load_results(spark, str(tmp_path / "entities.json"), str(tmp_path / "relations.json"))
    assert {r.entity_id: r.embedding for r in found["entities"].collect()} == {"a": [1.0, 2.5], "b": None}
    assert {r.chunk_id for r in found["chunks"].collect()} == {"c1", "1"} and found["relations"].first().weight == 2.0
    with pytest.raises(FileNotFoundError):
        readers.load_results(spark, str(tmp_path / "none.json"))
    readers.write_merged(found, str(tmp_path / "merged"))
    again = readers.load_merged(spark, str(tmp_path / "merged"))
    assert {n: sorted(map(repr, df.collect())) for n, df in again.items()} == {n: sorted(map(repr, df.collect())) for n, df in found.items()}
    nothing = readers.load_merged(spark, str(tmp_path / "missing"))
    assert [df.count() for df in nothing.values()] == [0, 0, 0]


def test_results_append(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path))
    e = lambda *rows: spark.createDataFrame(rows, "entity_id string, description string")
    r = lambda *rows: spark.createDataFrame(rows, "src_id string, tgt_id string, keywords string")
    c = lambda *rows: spark.createDataFrame(rows, store.chunks.schema)
    store.write(e(("a", "old")), r(("a", "b", "old")), c(("c1", "old", 1, 0, "d", "f"), ("c2", "two", 1, 1, "d", "f")))
    store.write(e(("a", "new"), ("b", "new")), r(("a", "b", "new"), ("b", "a", "new")), c(("c1", "new", 1, 0, "d", "f")), append=True)
    assert {x.entity_id: x.description for x in store.entities.read().collect()} == {"a": "old", "b": "new"}
    assert {(x.src_id, x.tgt_id): x.keywords for x in store.relations.read().collect()} == {("a", "b"): "old", ("b", "a"): "new"}
    assert {x.chunk_id: x.content for x in store.chunks.read().collect()} == {"c1": "new", "c2": "two"}
    store.write(e(("z", "only")), r())
    assert [x.entity_id for x in store.entities.read().collect()] == ["z"] and store.relations.read().count() == 0 and store.chunks.read().count() == 2


def test_new_files(spark, tmp_path):
    for name in ("a.md", "b.txt", "c.bin"):
        (tmp_path / name).write_text("x")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "d.md").write_text("x")
    names = lambda df: {r.file_path.rsplit("/", 1)[1] for r in df.collect()}
    first = readers.new_files(spark, str(tmp_path), spark.createDataFrame([], "file_path string"))
    assert names(first) == {"a.md", "b.txt"}
    assert names(readers.new_files(spark, str(tmp_path), first.where("file_path like '%a.md'"))) == {"b.txt"}


def test_info_and_edits(spark, tmp_path):
    kg = small_graph(spark, str(tmp_path))
    kg.link_vectors.upsert(spark.createDataFrame([("e1", "", "", [1.0, 0.0]), ("e2", "", "", [0.0, 1.0]), ("e3", "", "", [1.0, 1.0])], kg.link_vectors.schema))
    assert kg.entity_info("a", with_vector=True).first().embedding == [1.0, 1.0] and not kg.entity_info("zz").first().found
    assert kg.relation_info("b", "a", with_vector=True).first().embedding == [1.0, 0.0]
    out = kg.retrieve("hello", high="x")
    assert {r.id for r in out["all_chunks"].collect()} == {"c1", "c2"}
    kg.edit_relation("b", "a", {"keywords": "PART_OF", "weight": 7})
    assert [(r.keywords, r.weight) for r in kg.relation_info("a", "b").collect()] == [("PART_OF", 7.0)] and kg.link_vectors.read().count() == 2
    for wrong in ({"src_id": "x"}, {"none": 1}):
        with pytest.raises(ValueError):
            kg.edit_relation("a", "b", wrong)
    kg.edit_entity("c", {"description": "changed", "entity_id": "d"})
    assert kg.graph.has_edge("b", "d") and not kg.graph.has_node("c") and kg.entity_info("d").first().description == "changed"
    assert {r.id: r.content for r in kg.vectors.read().collect()}["d"] == "d\nchanged"
    with pytest.raises(ValueError):
        kg.edit_entity("d", {"entity_id": "a"})
    kg.edit_entity("d", {"entity_id": "a"}, allow_merge=True)
    assert {r.entity_id for r in kg.graph.nodes.read().collect()} == {"a", "b"} and {r.id for r in kg.vectors.read().collect()} == {"a", "b"}
    kg.delete_relation("b", "a")
    assert kg.graph.edges.read().count() == 0 and kg.graph.nodes.read().count() == 2
    kg.delete_entity("b")
    assert [r.entity_id for r in kg.graph.nodes.read().collect()] == ["a"] and [r.id for r in kg.vectors.read().collect()] == ["a"]


def test_evaluation(spark, tmp_path):
    (tmp_path / "cases.json").write_text(json.dumps({"test_cases": [{"question": "a", "ground_truth": "A"}, {"question": "b", "ground_truth": "B"}, {"question": "fail", "ground_truth": ""}]}))
    cases = readers.evaluation_cases(spark, str(tmp_path / "cases.json"))

    def answer(question):
        if question == "fail":
            raise RuntimeError("no answer")
        return question.upper(), ["context"]

    rows = evaluate.judged(cases, answer, lambda q, a, c, t: {"faithfulness": 1.0, "answer_relevance": 0.5 if q == "a" else math.nan, "context_recall": float(a == t)})
    got = {r.number: (r.answer, r.faithfulness, r.answer_relevance, r.context_precision, r.score, r.error) for r in rows.collect()}
    assert got == {1: ("A", 1.0, 0.5, None, 2.5 / 3, None), 2: ("B", 1.0, None, None, 1.0, None), 3: (None, None, None, None, 0.0, "RuntimeError: no answer")}
    total = evaluate.report(rows).first()
    assert (total.n, total.n_good, total.n_failed, total.mean_score, total.least_score, total.greatest_score) == (3, 2, 1, round((2.5 / 3 + 1) / 2, 4), 2.5 / 3, 1.0)
