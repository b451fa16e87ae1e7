"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words, all of them to its end. Each passage is encoded as a vector:
measures of its letters, marks and repetition, and signed hashed word counts. A gated attention,
softmax(w . (tanh(V h) * sigmoid(U h))) over the passages, weighs them, and the score is a sigmoid of the weighted
vector; both are learned together from document labels only (after Ilse et al., 2018, "Attention-based deep multiple
instance learning"), by Adam from a fixed seed.

The model is fitted on about TRAIN_DOCS labelled rows (twice as many at most), chosen by a hash of the id, whose texts have at most
TRAIN_PASSAGES passages together with their document's; scoring covers every text whole. Only the text is an input.

Null and empty texts are one passage of zeros, with a score like any other. Labels that are null, or that differ for
an id, aren't learned from; without labels every score is 0.5, with labels of one kind it is close to that kind.
Repeated rows get the same score. Empty tables give an empty result; extra columns are kept, but for those with the
name of an output column, which are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.scan import scan_text
from graphloom.llm.textkit import byte_blocks, find_words, gram_hashes, is_nonspace, lower_ascii, repeats, span_hashes

PASSAGE = 64
HASHED = 32
TRAIN_DOCS = 4000
TRAIN_PASSAGES = 100
THRESHOLD = 0.7
_MEASURES = 14
DIM = _MEASURES + HASHED


def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, first): the passages of text i are rows first[i]:first[i + 1], one at least."""
    vectors, counts = [], []
    for _, raw, off in byte_blocks(texts):
        w = find_words(is_nonspace(raw), off)
        n_words = np.diff(w.first)
        n_pass = np.maximum(1, -(-n_words // PASSAGE))
        base = np.concatenate(([0], np.cumsum(n_pass)))
        of = np.repeat(base[:-1], n_words) + (np.arange(len(w.starts)) - np.repeat(w.first[:-1], n_words)) // PASSAGE
        total = int(base[-1])
        words = np.maximum(np.bincount(of, minlength=total), 1)
        out = np.zeros((total, DIM), np.float32)

        def of_word(mask: np.ndarray, w=w) -> np.ndarray:
            sums = np.zeros(len(mask) + 1, np.int64)
            np.cumsum(mask, out=sums[1:])
            return sums[w.ends] - sums[w.starts]

        def mean(values: np.ndarray, of=of, total=total) -> np.ndarray:
            return np.bincount(of, values, total)

        points = of_word((raw & 0xC0) != 0x80)
        upper, digits = of_word((raw >= 65) & (raw <= 90)), of_word((raw >= 48) & (raw <= 57))
        wide = of_word(raw >= 128)
        plain = of_word(((raw | 32) >= 97) & ((raw | 32) <= 122))
        commas, marks = of_word((raw == 44) | (raw == 46)), of_word((raw == 33) | (raw == 63))
        chars = np.maximum(mean(points), 1)
        low = lower_ascii(raw)
        hashes = span_hashes(low, w.starts, w.ends)
        again, _ = repeats(of, hashes)
        pairs = gram_hashes(hashes, 2)
        pair_again, _ = repeats(of[: len(pairs)], pairs)
        next_same = np.zeros(len(hashes))
        if len(hashes) > 1:
            next_same[:-1] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
        rest = np.maximum(points - upper - digits - plain - commas - marks - wide, 0)
        for k, v in enumerate(
            (mean(points) / words / 8, mean(upper) / chars * 3, mean(upper == points) / words * 2, mean(digits) / chars * 5, mean(plain) / chars, mean(wide) / chars, mean(commas) / words, mean(marks) / words * 2, mean(rest) / chars * 5, mean(rest > 0) / words * 2,
             mean(again) / words * 2, np.bincount(of[: len(pairs)], pair_again, total) / words * 3, mean(next_same) / words * 3, np.log1p(np.bincount(of, minlength=total)) / 4)
        ):
            out[:, k] = v
        slot = (hashes >> np.uint64(8)) % np.uint64(HASHED)
        sign = np.where(hashes & np.uint64(1), 1.0, -1.0)
        bag = np.bincount(of * HASHED + slot.astype(np.int64), sign, total * HASHED).reshape(total, HASHED)
        out[:, _MEASURES:] = bag / np.sqrt(words)[:, None] / 3
        vectors.append(out)
        counts.append(n_pass)
    if not counts:
        return np.zeros((0, DIM), np.float32), np.zeros(1, np.int64)
    return np.concatenate(vectors), np.concatenate(([0], np.cumsum(np.concatenate(counts))))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class AttentionModel:
    """Gated attention over passages and a linear score of the weighted passage."""

    p: dict[str, np.ndarray]

    @classmethod
    def start(cls, hidden: int = 16, seed: int = 7) -> AttentionModel:
        g = np.random.default_rng(seed)
        return cls({"V": g.normal(0, 0.3, (DIM, hidden)), "U": g.normal(0, 0.3, (DIM, hidden)), "w": g.normal(0, 0.3, hidden), "c": np.zeros(DIM), "b": np.zeros(1)})

    def forward(self, x: np.ndarray, first: np.ndarray) -> tuple:
        p, at = self.p, first[:-1]
        t, s = np.tanh(x @ p["V"]), _sigmoid(x @ p["U"])
        e = (t * s) @ p["w"]
        sizes = np.diff(first)
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, at), sizes))
        a = e / np.repeat(np.add.reduceat(e, at), sizes)
        z = np.add.reduceat(a[:, None] * x, at, axis=0)
        return t, s, a, z, _sigmoid(z @ p["c"] + p["b"][0])

    def gradients(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, decay: float) -> dict[str, np.ndarray]:
        p, sizes = self.p, np.diff(first)
        t, s, a, z, q = self.forward(x, first)
        d = (q - y) / len(y)
        dz = np.repeat(d, sizes)[:, None] * p["c"]
        da = (dz * x).sum(1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, first[:-1]), sizes))
        ts = de[:, None] * p["w"]
        return {"V": x.T @ (ts * s * (1 - t * t)), "U": x.T @ (ts * t * s * (1 - s)), "w": (t * s).T @ de, "c": z.T @ d + decay * p["c"], "b": np.array([d.sum()])}

    def fit(self, bags: list[np.ndarray], y: np.ndarray, epochs: int = 30, batch: int = 128, rate: float = 0.02, decay: float = 1e-4, seed: int = 11) -> AttentionModel:
        g, m, v, step = np.random.default_rng(seed), {}, {}, 0
        for epoch in range(epochs):
            order = g.permutation(len(bags))
            for at in range(0, len(order), batch):
                part = order[at : at + batch]
                x = np.concatenate([bags[i] for i in part]).astype(np.float64)
                first = np.concatenate(([0], np.cumsum([len(bags[i]) for i in part])))
                step += 1
                for k, d in self.gradients(x, first, y[part], decay).items():
                    m[k] = 0.9 * m.get(k, 0) + 0.1 * d
                    v[k] = 0.999 * v.get(k, 0) + 0.001 * d * d
                    self.p[k] = self.p[k] - rate * (1 - epoch / epochs) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def score(self, texts: pa.Array) -> np.ndarray:
        x, first = encode(texts)
        return self.forward(x.astype(np.float64), first)[4] if len(first) > 1 else np.zeros(0)


def held_out(doc_id) -> F.Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", max_docs: int = TRAIN_DOCS, max_passages: int = TRAIN_PASSAGES) -> AttentionModel | None:
    """Fit on the labelled rows that aren't held out; None without any. What comes to the driver is bounded by
    2 * max_docs * max_passages vectors."""
    usable = labels.where(~held_out(doc_id)).groupBy(F.col(doc_id).alias("doc_id")).agg(F.min(label).alias("y"), F.max(label).alias("y2")).where("y = y2 and doc_id is not null")
    usable = usable.select("doc_id", "y")
    share = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1 << 40)) < int(min(1.0, max_docs / max(usable.count(), 1)) * (1 << 40))
    # ids are different here, so a share of the hashes is about max_docs rows; the limit only guards the bound
    chosen = usable.where(share).limit(2 * max_docs)
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id")

    def vectors(column: pa.Array) -> list:
        x, first = encode(column)
        return [pa.array([x[a:b].tobytes() if b - a <= max_passages else None for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())]

    rows = scan_text(texts, "text", "vectors binary", vectors, ["doc_id", "y"]).where("vectors is not null").toArrow()
    rows = sorted(zip(*(rows.column(c).to_pylist() for c in ("doc_id", "vectors", "y")), strict=True))
    if not rows:
        return None
    return AttentionModel.start().fit([np.frombuffer(r[1], np.float32).reshape(-1, DIM) for r in rows], np.array([float(r[2]) for r in rows]))


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None, threshold: float = THRESHOLD, **training) -> DataFrame:
    """The kept columns of docs with score and predicted (1 where the score reaches the threshold)."""
    model = train(docs, labels, doc_id, text, **training)

    def fields(column: pa.Array) -> list:
        score = model.score(column) if model else np.full(len(column), 0.5)
        return [pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32), pa.int32())]

    return scan_text(docs, text, "score double, predicted int", fields, keep)
