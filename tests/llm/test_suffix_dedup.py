import random
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import suffix_dedup

from .helpers import awkward, empty, sentences


def brute(texts, window=200):
    raw, seen, out = [(t or "").encode() for t in texts], Counter(), []
    for b in raw:
        seen.update(b[i : i + window] for i in range(len(b) - window + 1))
    for b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - window + 1):
            if seen[b[i : i + window]] > 1:
                gone[i : i + window] = True
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        out.append((len(b), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), sha256(kept).hexdigest()))
    return out


@settings(max_examples=80, deadline=None)
@given(st.binary(min_size=1, max_size=300), st.integers(1, 3))
def test_suffix_array(data, letters):
    text = np.frombuffer(data, np.uint8) % np.uint8(4**letters)
    order, _ = suffix_dedup.suffix_array(text)
    raw = text.tobytes()
    key = lambda i: raw[i : i + 200].ljust(200, b"\0")
    assert sorted(order.tolist()) == list(range(len(raw)))
    assert [key(i) for i in order] == sorted(key(i) for i in range(len(raw)))


@pytest.mark.parametrize(("chunk", "common"), [(2048, {}), (8, {}), (2048, {"common": 0.02, "common_least": 2}), (4, {"common": 0.02, "common_least": 2})])
def test_equal_to_brute_force(spark, chunk, common):
    g = random.Random(2)
    shared, rows = sentences(5, 5, (50, 70)), []
    for i, t in enumerate(sentences(6, 200, (20, 150))):
        parts = [t[: len(t) // 2], t[len(t) // 2 :]]
        if g.random() < 0.6:
            parts.insert(g.randint(0, 2), g.choice(shared))
        if g.random() < 0.2:
            parts = parts[:1] * 3
        rows.append((i, " ".join(parts)))
    rows += [(900, None), (901, ""), (902, "x" * 1000), (903, "xy" * 400), (904, rows[3][1]), (904, rows[3][1]), (905, "x" * 150), (None, shared[0]), (906, "\x00" * 500)]
    got = suffix_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), chunk=chunk, **common)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()) == sorted((str(d), *x) for (d, _), x in zip(rows, brute([t for _, t in rows]), strict=True))


def test_long_texts_in_pieces(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_PIECE", 700)
    raw = np.frombuffer(sentences(8, 1, (900, 900))[0].encode(), np.uint8)
    whole = suffix_dedup.segments(raw, np.array([0, len(raw)]))
    covered = np.zeros(len(raw), int)
    for start, size in zip(whole[1], whole[2], strict=True):
        covered[start : start + size] += 1
    assert (covered[: len(raw) - 199] == 1).all() and not covered[len(raw) - 199 :].any()


def test_awkward_and_empty(spark):
    rows = awkward(spark)
    got = suffix_dedup.deduplicate(rows, with_kept=True).collect()
    assert len(got) == rows.count()
    for r in got:
        assert len(r.kept) + r.n_removed == r.n_bytes
    assert next(r for r in got if r.doc_id == 6).n_removed == 6000
    assert suffix_dedup.deduplicate(empty(spark)).count() == 0
