"""Steps that grew faster than their input: what they return against plain versions, and how they are dealt."""

import random

from pyspark.sql import functions as F

from graphloom import fixtures as fx
from graphloom.operators import extract, hooks, maintain
from graphloom.sources import tables


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]


def test_rows_are_spread_over_tasks(spark, sf_dir):
    n = spark.sparkContext.defaultParallelism
    rows = tables.spread(spark.range(1000), "id")
    assert rows.rdd.getNumPartitions() == n and tables.spread(spark.range(1000), "id", each=10).rdd.getNumPartitions() == 100
    assert sorted(r.id for r in rows.collect()) == list(range(1000))
    # not joined again by Spark, and no second shuffle for repeats
    assert plan_of(fx.responses(spark, sf_dir)).count("REPARTITION_BY_NUM") == 1 and plan_of(fx.responses(spark, sf_dir)).count("Exchange hashpartitioning") == 1


def named_of(spark, g):
    named = [(g.choice("abcdef"), f"k{g.randrange(12)}") for _ in range(40)] + [("only", "k1")]
    return named, spark.createDataFrame(named, "key string, chunk_id string")


def test_lineage_of_rows(spark):
    named, rows = named_of(spark, random.Random(5))
    chunks = spark.createDataFrame([(f"k{i}", i % 4) for i in range(10)], "chunk_id string, doc_id int")
    want = {d: sorted({k for k, c in named if int(c[1:]) < 10 and int(c[1:]) % 4 == d}) for d in range(4)}
    got = maintain.lineage_of(rows, chunks).collect()
    assert {r.doc_id: (r.names, r.n) for r in got} == {d: (",".join(v), len(v)) for d, v in want.items() if v}
    assert sorted(map(tuple, got)) == sorted(map(tuple, maintain.lineage(rows.groupBy("key").agg(F.collect_set("chunk_id").alias("chunk_ids")), chunks).collect()))


def test_impact_of_rows(spark):
    named, rows = named_of(spark, random.Random(6))
    gone = spark.createDataFrame([("k1",), ("k1",), ("k2",)], "chunk_id string")
    hit = {k for k, c in named if c in ("k1", "k2")}
    left = {k: sorted({c for x, c in named if x == k} - {"k1", "k2"}) for k in hit}
    got = {r.key: (r.remaining, r.left, r.action) for r in maintain.deletion_impact_of(rows, gone).collect()}
    assert got == {k: (",".join(v), v, "rebuild" if v else "delete") for k, v in left.items()} and got["only"] == ("", [], "delete")


def test_gleaned_versions(spark):
    g = random.Random(7)
    some = lambda: {(f"c{g.randrange(9)}", g.choice("ab")): g.choice(["", "x", "yy", "zz", None]) for _ in range(14)}
    first, second = some(), some()
    df = lambda d, t: spark.createDataFrame([(c, n, t, "k", v) for (c, n), v in d.items()], "chunk_id string, name string, dim1 string, dim2 string, description string")
    size = lambda v: -1 if v is None else len(v)
    want = {k: 1 if k not in first or k in second and size(second[k]) > size(first[k]) else 0 for k in first | second}
    got = hooks.glean(df(first, "one"), df(second, "two"))
    assert {(r.chunk_id, r.name): (r.dim1, r.description, r.round) for r in got.collect()} == {k: (("one", "two")[r], (first, second)[r][k], r) for k, r in want.items()}
    assert "SortAggregate" not in plan_of(got) and plan_of(got).count("Exchange") == 1


def test_names_are_merged_from_one_list(spark):
    rows = spark.createDataFrame([("f", 2, 0, "c2", "n", "b,a", "x", "one"), ("f", 1, 0, "c1", "n", None, "y", "two"), ("f", 1, 1, "c1", "n", "c", "x", "one"), ("f", 3, 0, "c2", "n", "a", None, "on")], "file_path string, pos int, ord int, chunk_id string, name string, dim1 string, dim2 string, description string")
    got = extract.merge_same_names(rows, "file_path")
    assert tuple(got.first()) == ("f", "n", "a,b,c", "x,y", "two<SEP>one", "c1<SEP>c2") and plan_of(got).count("partial_collect_list") == 1
    alone = extract.merge_same_names(rows, "chunk_id").collect()
    assert {(r.chunk_id, r.description, r.source_id) for r in alone} == {("c1", "two<SEP>one", "c1"), ("c2", "one", "c2")}


def test_chunks_are_tracked_behind_one_shuffle(spark):
    nodes = spark.createDataFrame([("n", "k2<SEP> <SEP>k1<SEP>k2"), ("m", "")], "entity_id string, source_id string")
    edges = spark.createDataFrame([("e2", "b", "a", "k1"), ("e1", "a", "b", "k3<SEP>k1")], "edge_id string, src_id string, tgt_id string, source_id string")
    got = maintain.chunk_tracking(nodes, edges)
    assert {(r.kind, r.key): (r.chunk_ids, r.n) for r in got.collect()} == {("entity", "n"): (["k2", "k1"], 2), ("relation", "a<SEP>b"): (["k3", "k1"], 2)}
    assert plan_of(got).count("Exchange hashpartitioning") == 1


def test_inferred_ends_are_grouped_before_they_meet_known_names(spark):
    rels = spark.createDataFrame([("f", 1, 0, "c1", "a", "z", "k", "d"), ("f", 0, 0, "c0", "z", "a", "k", "d"), ("g", 0, 0, "c9", "a", "z", "k", "d")], "file_path string, pos int, ord int, chunk_id string, src_name string, tgt_name string, keywords string, description string")
    ents = spark.createDataFrame([("f", "a", "t", "u", "d", "c1")], "file_path string, name string, dim1 string, dim2 string, description string, source_id string")
    made, linked = extract.resolve_relations(rels, ents)
    inferred = made.where("data_source = 'inferred'")
    assert [(r.file_path, r.name, r.source_id) for r in inferred.collect()] == [("f", "z", "c0")] and linked.count() == 2
    plan = plan_of(inferred)
    assert plan.index("LeftAnti") < plan.index("min_by")
