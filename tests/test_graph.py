import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import align, budget, graph, vector
from graphloom.streaming import append


def edges_of(spark, pairs):
    return spark.createDataFrame([(f"e{i}", a, b, "k", 1.0) for i, (a, b) in enumerate(pairs)], "edge_id string, src_id string, tgt_id string, keywords string, weight double")


def test_roots_follow_chains(spark):
    pointers = [(i + 1, i) for i in range(100)] + [(500, 400)]
    got = {r.node: r.root for r in graph.roots(spark.createDataFrame(pointers, "node long, parent long")).collect()}
    assert got == {i: 0 for i in range(101)} | {500: 400, 400: 400}
    with pytest.raises(ValueError):
        graph.roots(spark.createDataFrame([(1, 2), (2, 1)], "node long, parent long"), max_rounds=4)


def test_breadth_first_is_capped_by_degree(spark):
    pairs = [("a", f"n{i}") for i in range(10)] + [("n3", f"m{i}") for i in range(5)] + [("n7", "m0"), ("n7", "m1")]
    got, cut = graph.breadth_first(edges_of(spark, pairs), "a", 3, 3)
    assert cut and {(r.entity_id, r.level) for r in got.collect()} == {("a", 0), ("n3", 1), ("n7", 1)}
    got, cut = graph.breadth_first(edges_of(spark, pairs), "a", 3, 100)
    assert not cut and got.count() == 16
    assert graph.breadth_first(edges_of(spark, pairs), "zz")[0].count() == 1


def test_pagerank_of_a_star(spark):
    nodes = spark.createDataFrame([(x,) for x in ("hub", "a", "b", "c", "alone")], "entity_id string")
    got = {r.entity_id: r.pagerank for r in graph.pagerank(edges_of(spark, [("hub", "a"), ("hub", "b"), ("c", "hub")]), nodes, rounds=60).collect()}
    hub = (0.15 + 0.85 * 0.45) / (1 - 0.85**2)
    assert got["hub"] == pytest.approx(hub, abs=1e-3) and got["a"] == pytest.approx(0.15 + 0.85 * hub / 3, abs=1e-3) and got["alone"] == pytest.approx(0.15)


def test_neighbour_search_in_chunks_equals_one_piece(spark):
    g = random.Random(1)
    rows = [(i, "big" if i % 3 else "small", [g.gauss(0, 1) for _ in range(8)]) for i in range(200)]
    vecs = spark.createDataFrame(rows, "id long, block string, embedding array<float>")
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(vector.nearest_in_block(vecs, 3, chunk=16)) == key(vector.nearest_in_block(vecs, 3))
    assert key(align.best_earlier(vecs, None, chunk=16)) == key(align.best_earlier(vecs, None))
    mapped = {r.id: r.root for r in align.align_by_threshold(vecs, 0.5).collect()}
    assert all(mapped[root] == root for root in mapped.values())


def test_polling_hands_quotas_on(spark):
    owners = spark.createDataFrame([("a", 1, [1]), ("b", 2, list(range(10, 20))), ("c", 3, [30, 31])], "owner string, pos int, chunks array<long>")
    got = budget.weighted_polling(owners, 5).groupBy("owner").agg(F.count("*").alias("n")).collect()
    assert {r.owner: r.n for r in got} == {"a": 1, "b": 7, "c": 1}
    one = spark.createDataFrame([("a", 1, [1, 2, 3])], "owner string, pos int, chunks array<long>")
    assert budget.weighted_polling(one, 2).count() == 2


def test_budgets(spark):
    rows = spark.createDataFrame([(i, 10) for i in range(5)], "i int, tokens int")
    assert [budget.within_budget(rows, "tokens", b, ["i"]).count() for b in (0, 9, 10, 35, 999)] == [0, 0, 1, 3, 5]
    x = spark.createDataFrame([("a", 1), ("b", 2)], "id string, rank int")
    y = spark.createDataFrame([("b", 1), ("c", 2)], "id string, rank int")
    assert [r.id for r in budget.interleave([x, y], "id").orderBy("place").collect()] == ["a", "b", "c"]


def test_stream_upserts(spark, tmp_path):
    source, table, at = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "state")
    source.mkdir()
    (source / "1.json").write_text('{"id": 1, "v": "a"}\n{"id": 2, "v": "b"}\n')
    run = lambda: append.append_to_table(append.stream_documents(spark, str(source), "id long, v string"), table, ["id"], at).awaitTermination()
    run()
    (source / "2.json").write_text('{"id": 2, "v": "c"}\n{"id": 3, "v": "d"}\n')
    run()
    assert sorted((r.id, r.v) for r in append.read_table(spark, table).collect()) == [(1, "a"), (2, "c"), (3, "d")]


def test_rows_of_a_block_meet_without_a_copy_for_each_chunk(spark):
    """A row is copied once for each piece of its block, whatever is multiplied at once; pieces are bounded."""
    vecs = spark.range(3000).select("id", F.lit("b").alias("block"), F.array_repeat(F.lit(1.0).cast("float"), 4).alias("embedding"))
    assert vector.pieces_of_blocks(vecs).count() == 6000
    wide = vecs.withColumn("embedding", F.array_repeat(F.lit(1.0).cast("float"), 1000))
    sides = {(r.side, r.i, r.j): r["count"] for r in vector.pieces_of_blocks(wide).groupBy("side", "i", "j").count().collect()}
    assert len(sides) == 18 and max(sides.values()) * 1000 < 1.2 * vector.PIECE


def test_best_rows_of_a_block_against_all_pairs(spark, monkeypatch):
    g = random.Random(2)
    rows = [(i * 3, g.choice("ab"), g.choice([[1.0, 0.0], [0.0, 0.0], [g.gauss(0, 1), g.gauss(0, 1)], [float("nan"), 1.0]])) for i in range(160)] + [(480, None, [1.0, 0.0])]
    unit = {i: None if v != v else [x / max(sum(y * y for y in v) ** 0.5, 1e-300) for x in v] for i, _, v in rows if v[0] == v[0]}
    score = lambda a, b: round(sum(x * y for x, y in zip(unit[a], unit[b], strict=True)), 4)
    blocks = {i: b for i, b, _ in rows if b and i in unit}
    ranked = lambda i, some: sorted((-score(i, j), j) for j in some if blocks[j] == blocks[i])
    near = {(i, j, -s, r + 1) for i in blocks for r, (s, j) in enumerate(ranked(i, blocks.keys() - {i})[:4])}
    first = {(i, r[0][1], -r[0][0]) for i in blocks if (r := ranked(i, [j for j in blocks if j < i]))}
    for piece in (vector.PIECE, 60):
        monkeypatch.setattr(vector, "PIECE", piece)
        vecs = spark.createDataFrame(rows, "id long, block string, embedding array<float>")
        got = vector.nearest_in_block(vecs, 4, chunk=7).collect()
        assert {(r.src, r.tgt, r.score, r["rank"]) for r in got} == near and len(got) == len(near)
        assert {tuple(r) for r in align.best_earlier(vecs, None, chunk=7).collect()} == first


def test_nodes_met_within_two_from_both_seeds(spark):
    g = random.Random(4)
    pairs = [(f"n{g.randrange(12)}", f"n{g.randrange(12)}") for _ in range(30)]
    edges = edges_of(spark, pairs)
    ways = [(f"e{i}", *p) for i, (a, b) in enumerate(pairs) for p in ((a, b), (b, a))]
    reach = lambda s: {(b, 1) for _, a, b in ways if a == s} | {(y, 2) for e, a, b in ways if a == s for f, x, y in ways if x == b and f != e}
    want = sorted((n, d1, d2) for n, d1 in reach("n1") for m, d2 in reach("n2") if n == m and n not in ("n1", "n2"))
    got = graph.met_within_two(edges, "n1", "n2")
    assert sorted(tuple(r) for r in got.collect()) == want
    # the edges aren't shuffled for each seed and way: nothing of them is left in the last plan
    assert "e0" not in got._jdf.queryExecution().executedPlan().toString() and "ExistingRDD" not in got._jdf.queryExecution().executedPlan().toString()
