import re
from hashlib import sha256

import pytest

from graphloom.llm import decontaminate

from .helpers import awkward, empty, lower_az, sentences

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def brute(docs, items, n=10):
    windows = []
    for item, t in items:
        w = re.findall(WORD, lower_az(t or ""))
        size = min(n, len(w))
        windows += [(item, tuple(w[i : i + size])) for i in range(len(w) - size + 1) if size]
    out = []
    for d, t in docs:
        w = re.findall(WORD, lower_az(t or ""))
        hit, found = set(), set()
        for item, gram in windows:
            for i in range(len(w) - len(gram) + 1):
                if tuple(w[i : i + len(gram)]) == gram:
                    hit |= set(range(i, i + len(gram)))
                    found |= {str(item)} if item is not None else set()
        out.append((str(d), len(w), len(hit), len(found), sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def data():
    text = sentences(9, 40, (1, 40), 30)
    items = [(i, t) for i, t in enumerate(text[:12])] + [(100, "Only three words"), (100, "only"), (101, None), (102, ""), (103, "..."), (None, text[3]), (11, text[11])]
    docs = [(i, t) for i, t in enumerate(text)] + [(50, f"x {text[0]} y, {text[1]}"), (51, "so ONLY; three-words here"), (52, None), (53, ""), (54, text[2].upper()), (54, text[2].upper())]
    return docs, items


@pytest.mark.parametrize(("part_bytes", "parts", "piece"), [(16 << 20, 2, 100_000), (16 << 20, 2, 7), (4000, 2, 7)])
def test_equal_to_brute_force(spark, part_bytes, parts, piece):
    docs, items = data()
    got = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), part_bytes=part_bytes, parts=parts, piece=piece)
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got.collect()) == brute(docs, items)


def test_removal(spark):
    docs, items = data()
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, hits string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {d for d, *_, bad in brute(docs, items) if not bad}
    left = decontaminate.without_hits(df, bench)
    assert left.columns == df.columns and {str(r.doc_id) for r in left.collect()} == want
    cut = {r.doc_id: r.text for r in decontaminate.without_hits(df, bench, remove="spans").collect()}
    assert cut[51] == "so  here" and cut[52] is None and cut[0] == ""


def test_awkward_and_empty(spark):
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    rows = awkward(spark)
    assert {str(r.doc_id) for r in decontaminate.decontaminate(rows, bench).where("contaminated").collect()} == {"4"}
    assert decontaminate.decontaminate(empty(spark), bench).count() == 0
    assert decontaminate.decontaminate(rows, empty(spark, "item_id long, text string")).where("contaminated").count() == 0


def test_the_set_stays_within_its_stated_size():
    import pickle

    words = [f"w{i * 7919 % 100_003}" for i in range(200_000)]
    items = [(str(i), " ".join(words[i * 100 : i * 100 + 100])) for i in range(2000)]
    built = decontaminate.NgramSet(items, 10)
    assert len(pickle.dumps(built, 5)) <= sum(len(t) + 64 for _, t in items) + decontaminate.WINDOW_BYTES * len(words)


def test_windows_that_share_a_hash(monkeypatch):
    """Words decide, not hashes."""
    import numpy as np
    import pyarrow as pa

    real = decontaminate.row_grams
    monkeypatch.setattr(decontaminate, "row_grams", lambda words, first, k: (real(words, first, k)[0], real(words, first, k)[1] % np.uint64(3)))
    docs, items = data()
    names = [(None if i is None else str(i), t) for i, t in items if t is not None]
    built = decontaminate.NgramSet(names, 10)
    found = decontaminate._find([built], None, pa.array([t for _, t in docs], pa.string()))
    report = decontaminate._report(pa.array([t for _, t in docs], pa.string()), found)
    got = sorted((str(d), *(c[k].as_py() for c in report[:5])) for k, (d, _) in enumerate(docs))
    assert got == brute(docs, items)
