"""Retrieval against plain versions on small graphs."""

import random

import pytest

from graphloom.plans import retrieve


def polled(owners, most, taken_before=()):
    """Chunks of (name, list of chunks) in order, by falling quotas; (chunk, owner, times named)."""
    counts, kept = {}, []
    for name, chunks in owners:
        mine = []
        for c in chunks:
            if c in taken_before:
                continue
            counts[c] = counts.get(c, 0) + 1
            if counts[c] == 1:
                mine.append(c)
        kept.append((name, mine))
    kept = [(name, sorted(mine, key=lambda c: -counts[c])) for (name, mine), (_, all_) in zip(kept, owners, strict=True) if any(c not in taken_before for c in all_)]
    n, out, left, unused = len(kept), [], [], 0
    for i, (name, mine) in enumerate(kept):
        quota = most if n == 1 else round(most - i / (n - 1) * (most - 1))
        out += [(c, name, counts[c]) for c in mine[:quota]]
        left += [(c, name, counts[c]) for c in mine[quota:]]
        unused += max(0, quota - len(mine))
    return out + ([] if n == 1 else left[:unused])


@pytest.mark.parametrize("seed", range(4))
def test_related_chunks(spark, seed):
    g = random.Random(seed)
    entities = [(f"e{i}", [f"c{g.randrange(30)}" for _ in range(g.randrange(12))]) for i in range(g.choice([1, 2, 9]))]
    links = [((f"e{i}", f"e{i + 1}"), [f"c{g.randrange(40)}" for _ in range(g.randrange(9))]) for i in range(5)]
    p = retrieve.QueryParam()
    of_entities = retrieve.related_chunks(spark.createDataFrame([(e, k + 1) for k, (e, _) in enumerate(entities)], "id string, rank long"), spark.createDataFrame(entities, "id string, chunk_ids array<string>"), ["id"], p)
    first = [(r.id, r.owner, r.n) for r in sorted(of_entities.collect(), key=lambda r: r["rank"])]
    assert first == polled(entities, 5)
    gone = {c for c, _, _ in first}
    of_links = retrieve.related_chunks(spark.createDataFrame([(*e, k + 1) for k, (e, _) in enumerate(links)], "src_id string, tgt_id string, rank long"), spark.createDataFrame([(*e, c) for e, c in links], "src_id string, tgt_id string, chunk_ids array<string>"), ["src_id", "tgt_id"], p, without=of_entities)
    assert [(r.id, tuple(r.owner), r.n) for r in sorted(of_links.collect(), key=lambda r: r["rank"])] == polled(links, 5, gone)


def test_chunks_of_all_kinds_in_turn(spark):
    vec = lambda *x: [float(v) for v in x]
    nodes = spark.createDataFrame([("a", "x", vec(1, 0)), ("b", "x", vec(1, 1)), ("c", "x", vec(0, 1))], "id string, block string, embedding array<double>")
    links = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 2.0)], "src_id string, tgt_id string, weight double")
    degrees = spark.createDataFrame([("a", 1), ("b", 2), ("c", 1)], "id string, degree long")
    chunks = spark.createDataFrame([("k1", 5, vec(1, 0)), ("k2", 5, vec(0, 1)), ("k3", 5, vec(1, 2)), ("k4", 5, vec(2, 1))], "id string, tokens long, embedding array<double>")
    link_vectors = spark.createDataFrame([("a", "b", 1.0, vec(1, 0)), ("b", "c", 2.0, vec(0, 1))], "src_id string, tgt_id string, weight double, embedding array<double>")
    entity_sources = spark.createDataFrame([("a", ["k1", "k4"]), ("b", ["k4", None]), ("c", [])], "id string, chunk_ids array<string>")
    link_sources = spark.createDataFrame([("a", "b", ["k4"]), ("b", "c", ["k2", "k3"])], "src_id string, tgt_id string, chunk_ids array<string>")
    g = retrieve.Graph(nodes, links, degrees, chunks, link_vectors, entity_sources, link_sources)
    out = retrieve.retrieve(g, [1.0, 0.0], retrieve.QueryParam(mode="mix", chunk_top_k=2), high=[0.0, 1.0])
    order = lambda name, *cs: [tuple(r[c] for c in cs) for r in sorted(out[name].collect(), key=lambda r: r["rank" if "rank" in r and "place" not in r else "place"])]
    assert order("local_entities", "id") == [("a",), ("b",)]
    # the high-level vector finds the other link
    assert order("global_relations", "src_id", "tgt_id") == [("b", "c")]
    assert order("entities", "id") == [("a",), ("b",), ("c",)]
    assert order("entity_chunks", "id", "owner", "n") == [("k4", "a", 2), ("k1", "a", 1)]
    assert order("relation_chunks", "id") == [("k2",), ("k3",)]
    assert {i for (i,) in order("all_chunks", "id")} == {"k1", "k2", "k3", "k4"}
    # a chunk without a vector: by weight again
    part = retrieve.Graph(nodes, links, degrees, chunks.where("id <> 'k4'"), link_vectors, entity_sources)
    got = retrieve.retrieve(part, [1.0, 0.0], retrieve.QueryParam(mode="local", pick="vector"))["entity_chunks"]
    assert [r.id for r in got.orderBy("rank").collect()] == ["k4", "k1"]
    assert retrieve.related_chunks(spark.createDataFrame([], "id string, rank long"), entity_sources, ["id"], retrieve.QueryParam()).count() == 0
