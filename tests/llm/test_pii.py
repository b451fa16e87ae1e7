import random
import re
import time
from hashlib import sha256

import duckdb

from graphloom.llm import pii

from .helpers import awkward, empty


def plain(text):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub(r"\D", "", m.group())
        doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        if 16 <= len(digits) <= 19 and sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0:
            out.append((2, *m.span()))
    return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub(r"\D", "", m.group())) <= 15]


def test_base_spans_equal_the_patterns():
    g = random.Random(4)
    for alphabet in ("a1.@+- ()9%b", "1.25 ", "+1 (5)-", "4111 -"):
        for _ in range(4000):
            text = "".join(g.choice(alphabet) for _ in range(g.randint(0, 40)))
            assert pii.base_spans(text) == plain(text), text


def test_long_runs_take_linear_time():
    assert pii.base_spans("a" * 200_000 + "@" + "1" * 200_000 + "+" * 1000 + "x") == []
    assert len(pii.base_spans("1." * 100_000)) == 25_000


def _model():
    g = random.Random(5)
    texts = []
    for _ in range(300):
        number = f"+1 ({g.randint(200, 999)}) 555-{g.randint(1000, 9999)}"
        again = g.choice(["", f" and again {number} or {number} at once"])
        texts.append(f"call {number} or write to u{g.randint(1, 99)}@mail{g.randint(1, 9)}.org about version {g.randint(1, 9)}.{g.randint(0, 9)} in {g.randint(1900, 2030)}{again}")
    return pii.SkipChainCRF().fit(pii.build(texts, [pii.base_spans(t) for t in texts]))


def test_repeated_tokens_agree():
    model = _model()
    text = "call +1 (212) 555-1234 now. Later the same 555-1234 again, in 1999 and version 2.1"
    base = pii.base_spans(text)
    added = model.added([text], [base])[0]
    assert [(k, text[s:e]) for k, s, e in added] == [(3, "555-1234")]
    alone = "the year 1999, version 2.1 and room 12"
    assert model.added([alone], [pii.base_spans(alone)]) == [[]]


def test_message_passing_is_exact_on_a_chain():
    import itertools

    import numpy as np

    model = _model()
    text = "555-1234 and later 555-1234"
    g = pii.build([text], [[]])
    assert len(g.label) == 2 and not len(g.chain) and len(g.skip) == 1
    local, total = model.unary[g.features].sum(1), np.zeros((2, 5))
    for a, b in itertools.product(range(5), repeat=2):
        p = np.exp(local[0, a] + local[1, b] + model.skip[a, b])
        total[0, a] += p
        total[1, b] += p
    assert np.allclose(model.marginals(g, 60), total / total.sum(1, keepdims=True), atol=1e-4)


def test_find_and_redact(spark):
    docs = awkward(spark, [(20, "mail a.b@c.org, 10.0.0.1 and 999.1.1.1", "en", "a", 1), (21, "card 4111 1111 1111 1111", "en", "a", 1)])
    got = {str(r.doc_id): r for r in pii.find(docs, keep=["doc_id", "spans"], model=_model()).collect()}
    r = got["20"]
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 0, 0)
    assert r.base_sha256 == sha256(b"email:5:14,ip:16:24").hexdigest() and r.spans.startswith("email:5:14,ip:16:24")
    assert got["1"].base_sha256 == sha256(b"").hexdigest() and got["1"].spans == ""
    clean = pii.redact(docs, model=_model())
    assert clean.columns == docs.columns
    text = {str(x.doc_id): x.text for x in clean.collect()}
    assert text["21"] == "card [CARD]" and text["20"].startswith("mail [EMAIL], [IP]") and text["1"] is None and text["4"] == "one two three"
    assert pii.find(empty(spark)).count() == 0 and pii.redact(empty(spark)).count() == 0


def test_messages_settle():
    import numpy as np

    text = "call +1 (212) 555-1234 now. " + "then later the same year5551234 again " * 30
    g = pii.build([text], [pii.base_spans(text)])
    model = _model()
    model.skip = 4 * np.eye(5)  # so strong that labels carry over many tokens
    assert np.allclose(model.marginals(g), model.marginals(g, 2000), atol=1e-3)


def test_any_text_takes_linear_time():
    model = _model()
    for text in ("字" * 1_000_000 + "1", "a1" * 500_000, "b" * 1_000_000 + "@c.de", "1 " * 20_000):
        began = time.perf_counter()
        model.added([text], [pii.base_spans(text)])
        assert time.perf_counter() - began < 5


def test_every_overlap_with_a_base_span_is_clamped():
    text = "a1;+1 555 123 4567" + " x" * 3 + " 4111 1111 1111 1111 " + ",".join(f"u{i}@m.org" for i in range(9)) + " 7"
    base = pii.base_spans(text)
    g = pii.build([text], [base])
    for (s, e), label in zip(g.spans, g.label, strict=True):
        over = [k + 1 for k, a, b in base if a < e and b > s]
        assert label in over if over else label == 0


def test_loopy_marginals_are_close_to_all_labellings():
    import itertools

    import numpy as np

    model = _model()
    text = "555-1234 5551234 ... 555-1234 and 5551234"
    g = pii.build([text], [[]])
    n = len(g.label)
    assert n == 4 and len(g.chain) >= 1 and len(g.skip) >= 3
    local, total = model.unary[g.features].sum(1), np.zeros((n, 5))
    for labels in itertools.product(range(5), repeat=n):
        z = sum(local[i, k] for i, k in enumerate(labels)) + sum(model.chain[labels[a], labels[b]] for a, b in g.chain) + sum(model.skip[labels[a], labels[b]] for a, b in g.skip)
        total[range(n), labels] += np.exp(z)
    assert np.allclose(model.marginals(g), total / total.sum(1, keepdims=True), atol=0.05)


def test_gradient_of_the_likelihood_on_a_tree():
    import itertools

    import numpy as np

    model = _model()
    text = "555-1234 99 then 555-1234"
    g = pii.build([text], [[]])
    clamp = np.full(len(g.label), -1)
    clamp[0] = 4
    sums, norm = np.zeros((5, 5)), 0.0
    local = model.unary[g.features].sum(1)
    for labels in itertools.product(range(5), repeat=len(clamp)):
        if labels[0] == 4:
            p = np.exp(sum(local[i, k] for i, k in enumerate(labels)) + sum(model.chain[labels[a], labels[b]] for a, b in g.chain) + sum(model.skip[labels[a], labels[b]] for a, b in g.skip))
            norm += p
            for a, b in g.skip:
                sums[labels[a], labels[b]] += p
    assert np.allclose(model._expected(g, clamp)["skip"], (sums + sums.T) / 2 / norm, atol=1e-3)


def test_masked_spans_of_held_out_texts_are_found():
    """Each base span of texts that weren't learned from is masked with a chance of a half; the field finds it by the rest."""
    table = duckdb.sql("SELECT DISTINCT text FROM '/root/testdata/sf0.1/documents.parquet' WHERE regexp_matches(text, '[0-9@]') ORDER BY md5(text)").fetchall()
    learned, held = [t for t, in table[::2]], [t for t, in table[1::2]]
    model = pii.SkipChainCRF().fit(pii.build(learned, [pii.base_spans(t) for t in learned]))
    g = random.Random(3)
    found = wanted = wrong = 0
    for text in held:
        base = [(b, g.random() < 0.5) for b in pii.base_spans(text)]
        added = model.added([text], [[b for b, masked in base if not masked]])[0]
        gone = [b for b, masked in base if masked]
        hits = [any(k == x and s < e2 and e > s2 for x, s2, e2 in added) for k, s, e in gone]
        found, wanted = found + sum(hits), wanted + len(gone)
        wrong += sum(not any(s < e2 and e > s2 for _, s2, e2 in gone) for _, s, e in added)
    assert found / wanted > 0.7 and found / (found + wrong) > 0.9, (found, wanted, wrong)
    assert sum(map(len, model.added(held, [pii.base_spans(t) for t in held]))) > 0
