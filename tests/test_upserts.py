"""Upserts against plain versions, with hubs, repeats and limits."""

import random

import pytest

from graphloom.operators import merge
from graphloom.schema import SEP


def newest(rows, limit):
    """Sources of (age, ts, source) in the order in which they are first met, the last limit of them."""
    seen = list(dict.fromkeys(s for _, _, s in sorted(rows)))
    return seen[len(seen) - limit :] if 0 < limit < len(seen) else seen if limit > 0 else []


@pytest.mark.parametrize("limit", [0, 1, 7, 300])
def test_upserts(spark, limit):
    g = random.Random(limit)
    some = lambda n: [(g.choice(["hub", "hub", "hub", "a", "b"]), g.choice(["t", "u"]), g.choice(["one", "two words", "three", ""]), f"s{g.randrange(60)}", g.randrange(9)) for _ in range(n)]
    old, new = some(80), some(120)
    kind = "entity_id string, entity_type string, description string, source_id string, ts int"
    got = {r.entity_id: r for r in merge.upsert_nodes(spark.createDataFrame(old, kind), spark.createDataFrame(new, kind), limit).collect()}
    every = [(0, *r) for r in old] + [(1, *r) for r in new]
    for name in {r[1] for r in every}:
        mine = [r for r in every if r[1] == name]
        types = [r[2] for r in mine]
        assert got[name].entity_type == min(set(types), key=lambda t: (-types.count(t), t))
        assert got[name].description == SEP.join(dict.fromkeys(d for _, _, _, d in sorted((r[0], r[5], -len(r[3]), r[3]) for r in mine)))
        assert got[name].source_id == SEP.join(newest([(r[0], r[5], r[4]) for r in mine], limit)) and got[name].n_sources == len({r[4] for r in mine})
    links = lambda n: [(*g.choice([("a", "b"), ("b", "a"), ("c", "a")]), g.randrange(5), g.choice(["x,y", "z", "y"]), f"s{g.randrange(40)}", g.randrange(9)) for _ in range(n)]
    kind = "src_id string, tgt_id string, weight int, keywords string, source_id string, ts int"
    old, new = links(50), [*links(70), ("d", "e", 1, None, None, 0)]
    rows = [(0, *r) for r in old] + [(1, *r) for r in new]
    for r in merge.upsert_edges(spark.createDataFrame(old, kind), spark.createDataFrame(new, kind), limit).collect():
        mine = [x for x in rows if sorted(x[1:3]) == [r.src_id, r.tgt_id]]
        assert r.weight == sum(x[3] for x in mine) and r.edge_key == f"{r.src_id}{SEP}{r.tgt_id}"
        assert r.keywords == ",".join(sorted({w for x in mine if x[4] for w in x[4].split(",")}))
        assert r.source_id == SEP.join(newest([(x[0], x[6], x[5]) for x in mine if x[5]], limit))
    assert merge.upsert_edges(spark.createDataFrame(old, kind), spark.createDataFrame(new, kind)).count() == 3
