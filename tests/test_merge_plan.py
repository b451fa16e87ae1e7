from collections import Counter, defaultdict

from graphloom import fixtures as fx
from graphloom import queries_more


def test_merge_plan_covers_the_whole_graph(spark, sf_dir):
    nodes = {r.entity_id: r.dim2 for r in fx.nodes(spark, sf_dir).collect()}
    low = {kind: min(i for i, k in nodes.items() if k == kind) for kind in set(nodes.values())}
    weight, number, words = Counter(), Counter(), defaultdict(set)
    for e in fx.edges(spark, sf_dir).collect():
        if (pair := (low[nodes[e.src_id]], low[nodes[e.tgt_id]]))[0] != pair[1]:
            weight[pair] += e.weight
            number[pair] += 1
            words[pair].add(e.keywords)
    got = {(r.src_id, r.tgt_id): (r.weight, r.n_merged, r.keywords) for r in queries_more.merge_plan(spark, sf_dir).collect()}
    assert got == {p: (weight[p], number[p], ",".join(sorted(words[p]))) for p in weight}
    assert {p[0][0] for p in got} == {"c", "s", "n"}
