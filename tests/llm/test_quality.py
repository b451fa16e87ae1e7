import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from graphloom.llm import quality_classifier, quality_rules

from .helpers import awkward, empty, sentences, words


def measures(text):
    t = text or ""
    w, lines = words(t), [x for x in t.split("\n") if words(x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(grams)
    marked = {j for i, x in enumerate(grams) if often[x] > 1 for j in range(i, i + 3)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(marked), len(lines), len(re.findall("[A-Z]", t)), t.count("!"))


def test_measures_equal_plain_ones(spark):
    texts = [None, "", " ", "a b c a b c", "x\nx\n\n x\nx", "#% a <b>|&$*", "é ü z \x0b\x0c\r", "A" * 5000, *sentences(1, 50, (1, 300), 6)]
    got = list(zip(*(c.to_pylist() for c in quality_rules.measure(pa.array(texts))), strict=True))
    assert got == [measures(t) for t in texts]


def test_ledger_policies_and_ablations(spark):
    rows = quality_rules.ledger(awkward(spark), keep=["doc_id", "failed"])
    assert rows.columns[0] == "doc_id" and rows.columns.count("failed") == 1
    judged = quality_rules.apply_policy(rows).collect()
    names = list(quality_rules.RULES)
    for r in judged:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (r.failed & quality_rules.mask_of(quality_rules.POLICIES["v1"]) == 0)
    for r in quality_rules.ablations(rows).collect():
        bit = 1 << names.index(r.rule)
        assert (r.n_failed, r.n_only_this, r.n_rejected, r.n_all) == (sum(bool(x.failed & bit) for x in judged), sum(x.failed == bit for x in judged), sum(x.failed != 0 for x in judged), len(judged))
    assert quality_rules.apply_policy(quality_rules.ledger(empty(spark)), "base").count() == 0


def test_attention_gradients():
    g = np.random.default_rng(0)
    m = quality_classifier.AttentionModel.start(4)
    m.p["c"] = g.normal(0, 0.5, quality_classifier.DIM)
    x, first, y = g.normal(0, 1, (7, quality_classifier.DIM)), np.array([0, 3, 7]), np.array([1.0, 0.0])

    def loss():
        q = m.forward(x, first)[4]
        return -np.mean(y * np.log(q) + (1 - y) * np.log(1 - q))

    grads = m.gradients(x, first, y, 0.0)
    for k, v in m.p.items():
        at = np.unravel_index(v.size // 2, v.shape)
        keep = v[at]
        v[at] = keep + 1e-5
        up = loss()
        v[at] = keep - 1e-5
        down = loss()
        v[at] = keep
        assert abs((up - down) / 2e-5 - grads[k][at]) < 1e-6


def test_every_passage_counts():
    x, first = quality_classifier.encode(pa.array([None, "", "a " * 64, "a " * 65, "b " * 640]))
    assert np.diff(first).tolist() == [1, 1, 1, 2, 10] and x.shape == (15, quality_classifier.DIM)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = quality_classifier.classify(spark.read.parquet(f"{d}/documents.parquet"), labels, keep=["doc_id"]).join(labels, "doc_id").where(quality_classifier.held_out("doc_id"))
    rows = got.collect()
    assert len(rows) > 50 and sum(r.predicted == r.quality for r in rows) / len(rows) >= 0.97


def test_awkward_without_and_with_odd_labels(spark):
    rows = awkward(spark)
    none = quality_classifier.classify(rows, empty(spark, "doc_id long, quality int, toxic int"))
    assert none.columns.count("score") == 1 and {r.score for r in none.collect()} == {0.5}
    labels = spark.createDataFrame([(4, 1), (4, 0), (7, 1), (9, 0), (None, 1), (1, 1), (2, None)], "doc_id long, quality int")
    first = quality_classifier.classify(rows, labels).collect()
    again = quality_classifier.classify(rows, labels).collect()
    assert first == again and all(0 <= r.score <= 1 for r in first)
    assert quality_classifier.classify(empty(spark), labels).count() == 0


def test_clashing_columns(spark):
    df = awkward(spark).withColumn("n_words", F.lit("mine"))
    assert quality_rules.ledger(df).schema["n_words"].dataType.typeName() == "long"
