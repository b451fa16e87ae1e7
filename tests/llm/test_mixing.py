import random

import pytest

from graphloom.llm import mixing

from .helpers import awkward, empty, words


def water(sizes, weights=(5, 2, 1), percent=150, most=2):
    """Rounds of clamping and sharing the excess by weight."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    budget, clamped = sum(sizes.values()) * percent / 100, {}
    while True:
        free = [s for s in order if s not in clamped]
        level = (budget - sum(clamped.values())) / sum(weight[s] for s in free) if free else 0
        above = [s for s in free if weight[s] * level > most * sizes[s]]
        if not above:
            return clamped | {s: weight[s] * level for s in free}
        clamped |= {s: most * sizes[s] for s in above}


@pytest.mark.parametrize("seed", range(4))
def test_targets_equal_rounds(spark, seed):
    g = random.Random(seed)
    sizes = {f"s{i}": g.choice([0, 3, 50, 400, 90_000]) for i in range(g.randint(1, 14))} | {None: 77, "é": 12, "Z": 5}
    got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    want = water(sizes)
    assert {r.source: pytest.approx(r.target) for r in got} == want


def test_mix(spark):
    g = random.Random(9)
    rows = [(i, "w " * g.randint(0, 40), "en", g.choice(["a", "a", "a", "b", "c", None]), 0) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = mixing.mix(docs, keep=["text", "size"]).collect()
    assert len(got) == len(rows)
    want = water({s: sum(len(words(r[1])) for r in rows if r[3] == s) for s in {r[3] for r in rows}})
    for s, target in want.items():
        mine = [r for r in got if r.source == s]
        assert all(r.target == pytest.approx(target) and r.taken == r.copies * r.size and r.taken <= 2 * r.size for r in mine)
        assert abs(sum(r.taken for r in mine) - target) <= 40
        assert {r.source_size for r in mine} == {sum(r.size for r in mine)}
    pick = lambda rs: sorted((r.doc_id, r.taken) for r in rs)
    assert pick(got) == pick(mixing.mix(docs.repartition(7)).collect())
    assert pick(got) != pick(mixing.mix(docs, seed=1).collect())


def test_awkward_and_empty(spark):
    rows = awkward(spark)
    got = mixing.mix(rows, keep=rows.columns)
    assert got.count() == rows.count() and got.where("size = 0 and taken > 0").count() == 0
    assert mixing.mix(empty(spark)).count() == 0
    assert mixing.mix(rows.where("text is null")).collect()[0].target == 0
