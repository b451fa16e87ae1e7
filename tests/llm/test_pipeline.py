import corpus_pipeline
from graphloom.llm import queries

from .helpers import DOCS as SCHEMA
from .helpers import awkward, empty
from .test_ngram_join import families, sets_of

DOCS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_take_effect(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    before = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, before, d).cache()
        ids = {r.doc_id for r in after.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in before.select("doc_id").collect()}, name
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == DOCS, name
        before = after
    assert before.where("size > 0").groupBy("doc_id").count().where("count > 2").count() == 0
    assert corpus_pipeline.run(spark, d).count() == before.count()


def test_stage_results_equal_their_operators(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    assert ids(corpus_pipeline.quality(spark, docs, d)) == ids(queries.op1_quality_classifier(spark, d).where("predicted = 1"))
    assert ids(corpus_pipeline.near_duplicates(spark, docs, d)) == ids(queries.op3_ngram_join(spark, d).where("doc_id = component_id"))
    assert ids(corpus_pipeline.decontamination(spark, docs, d)) == ids(queries.op7_decontamination(spark, d).where("not contaminated"))
    clean = {r.doc_id: r.text for r in corpus_pipeline.personal_data(spark, docs, d).collect()}
    hit = {r.doc_id for r in queries.op6_personal_data(spark, d).where("spans <> ''").collect()}
    assert {r.doc_id for r in docs.collect() if r.text != clean[r.doc_id]} == hit and hit


def test_awkward_and_empty_documents(spark):
    """Nulls, empty and long texts, repeated rows, clashing columns and no rows at all go through every stage."""
    d = "/root/testdata/sf0.001"
    for docs in (awkward(spark), empty(spark, SCHEMA)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, d)
            assert len(out.columns) == len(set(out.columns)) and set(docs.columns) <= set(out.columns), name
            assert {str(r.doc_id) for r in out.select("doc_id").collect()} <= {str(r.doc_id) for r in docs.collect()}, name
    assert {str(r.doc_id) for r in corpus_pipeline.near_duplicates(spark, awkward(spark), d).collect()} == {"1", "2", "3", "4", "6", "7", "8", "9", "None"}
    assert corpus_pipeline.personal_data(spark, awkward(spark), d).count() == awkward(spark).count()


def lowest_of_groups(rows, k, percent):
    sets, low = sets_of([t for _, t in rows], k), [d for d, _ in rows]
    links = [(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets[:i]) if 100 * len(x & y) >= percent * len(x | y)]
    while any(low[i] != low[j] for i, j in links):
        for i, j in links:
            low[i] = low[j] = min(low[i], low[j])
    return sorted(set(low))


def test_near_duplicates_equal_brute_force(spark):
    rows = families(5) + [(1, "A b c d"), (2, "a b c D"), (3, "a b c e")]
    docs = spark.createDataFrame([(d, t, "en", "a", len(t)) for d, t in rows], SCHEMA)
    want = lowest_of_groups(rows, 5, 80)
    assert want != lowest_of_groups(rows, 4, 85)
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == want


def test_a_text_goes_to_python_once(spark):
    """What the quality stage sends to its classifier are the columns of documents, each once."""
    d = "/root/testdata/sf0.001"
    plan = corpus_pipeline.quality(spark, spark.read.parquet(f"{d}/documents.parquet"), d)._jdf.queryExecution().analyzed()
    while plan.nodeName() != "MapInArrow":
        plan = plan.children().head()
    sent = plan.children().head().schema()
    assert sorted(sent.apply(i).dataType().simpleString() for i in range(sent.length())) == ["bigint", "bigint", "string", "string", "string"]
