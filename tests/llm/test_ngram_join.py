import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import ngram_join

from .helpers import awkward, empty, lower_az, words


def sets_of(texts, k=4):
    out = []
    for t in texts:
        w = words(lower_az(t or ""))
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    return out


def brute(rows):
    sets, parent, index = sets_of([t for _, t in rows]), list(range(len(rows))), {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        for g in s:
            index.setdefault(g, []).append(i)
    for i, s in enumerate(sets):
        for j, n in Counter(j for g in s for j in index[g] if j < i).items():
            if 100 * n >= 85 * (len(s) + len(sets[j]) - n):
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted((str(d), len(sets[i]), low.get(find(i))) for i, (d, _) in enumerate(rows))


def families(seed):
    g = random.Random(seed)
    pool = [f"w{i}" for i in range(300)]
    rows, base = [], [g.choice(pool) for _ in range(120)]
    for i in range(150):
        copy = list(base)
        for _ in range(g.randint(0, 9)):
            copy[g.randrange(120)] = g.choice(pool)
        rows.append((1000 + i, " ".join(copy)))
    shared = " ".join(g.choice(pool) for _ in range(60))
    return rows + [(3000 + i, shared + " " + " ".join(g.choice(pool) for _ in range(g.randint(0, 40)))) for i in range(60)]


@pytest.mark.parametrize(("chunk", "heavy"), [(1024, {}), (16, {"heavy": 0.02, "heavy_least": 2}), (64, {"heavy": 0.3, "heavy_least": 2})])
def test_components_equal_brute_force(spark, chunk, heavy):
    rows = families(3)
    rows += [(9000 + i, t.upper()) for i, (_, t) in enumerate(rows[::3])] + [(5000, None), (5001, ""), (5002, " \n"), (5003, "A b"), (5004, "a B"), (5005, "a"), (5003, "A b"), (None, "a b"), (None, None)]
    got = ngram_join.components(spark.createDataFrame(rows, "doc_id long, text string"), chunk=chunk, **heavy)
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in got.collect()) == brute(rows)


def test_awkward_and_empty(spark):
    rows = awkward(spark)
    got = ngram_join.components(rows).collect()
    assert len(got) == rows.count()
    assert {r.component_id for r in got if r.doc_id == 4} == {4}
    assert ngram_join.components(empty(spark)).count() == 0


def test_one_of_each(spark):
    rows = families(4)
    docs = spark.createDataFrame([(d, t, "en", "a", 1) for d, t in rows] + [(1, None, "en", "a", 0), (2, "", "en", "a", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in brute(rows)} | {1, 2})
    again = awkward(spark)
    assert sorted(str(r.doc_id) for r in ngram_join.one_of_each(again).collect()) == ["1", "2", "3", "4", "6", "7", "8", "9", "None"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 30), min_size=1, max_size=25), min_size=1, max_size=20), st.integers(50, 100))
def test_divide_skip_finds_all(sets, percent):
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    index = ngram_join.DivideSkip(arrays, np.array([len(s) for s in sets]), percent)
    for i, s in enumerate(sets):
        want = {j for j, t in enumerate(sets) if 100 * len(s & t) >= percent * len(s | t)}
        assert set(index.search(arrays[i], len(s))) == want


def test_divide_skip_on_long_lists():
    g = random.Random(1)
    base = set(range(200))
    sets = [(base - set(g.sample(sorted(base), g.randint(0, 30)))) | {1000 + i} for i in range(300)]
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    index = ngram_join.DivideSkip(arrays, np.array([len(s) for s in sets]))
    for i in range(0, 300, 37):
        want = {j for j, t in enumerate(sets) if 100 * len(sets[i] & t) >= 85 * len(sets[i] | t)}
        assert set(index.search(arrays[i], len(sets[i]))) == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sets(st.integers(0, 40), min_size=1, max_size=30), min_size=1, max_size=12), st.integers(1, 8))
def test_merge_counts_what_stands_in_enough_lists(lists, least):
    index = ngram_join.DivideSkip([], np.zeros(0))
    places, at = [], 0
    for x in lists:
        index.docs = index.docs[:at] + sorted(x)
        places.append((at, at + len(x)))
        at += len(x)
    want = {d: n for d, n in Counter(d for x in lists for d in x).items() if n >= least}
    assert dict(index._merge(places, least)) == want


def test_common_shingles_are_found_however_small_batches_are(spark):
    """A hot shingle is counted over a block of texts, not over an Arrow batch."""
    rows = [(i, "the same four words " + " ".join(f"x{i}y{j}" for j in range(20))) for i in range(300)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
        fields = ["doc_id", "n_shingles", "sig", "common"]
        base = docs.mapInArrow(ngram_join._sizes_and_common(4, 0.5, 16, fields), "doc_id bigint, n_shingles bigint, sig bigint, common array<struct<token:bigint,n:bigint>>")
        assert len(ngram_join.common_shingles(base, 0.5)) == 1
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
