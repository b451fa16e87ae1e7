"""Personal data: fixed patterns, and a skip-chain conditional random field over the tokens they leave open.

The patterns give the base spans (email, ip, card, phone; leftmost, non-overlapping within a kind, a failing match
dropped). The nodes of the field are the tokens of a document (runs without white space) that hold a digit or '@'.
Unary potentials come from shapes of a token and its neighbours; chain edges join tokens that follow each other within
MAX_GAP characters; skip edges join distant tokens that are equal or similar (the same letters and digits, the same last
seven digits, the same name before '@'), each with the next such token, so that edges stay linear in tokens. Loopy
sum-product message passing enforces that such tokens agree; tokens of base spans are clamped to their kind. A token
that isn't in a base span becomes a span if its marginal for a kind reaches MARGINAL.

All potentials are learned together, by the gradient of the conditional likelihood with loopy marginals: in each step a
random half of the base spans is masked, and the field has to find them again from the others (negative phase: masked
ones free) as against all of them clamped (positive phase). Tokens without a base span count as no personal data, but
for those that match a pattern by themselves (two card numbers in a row match none): they are latent. The field is
learned from about TRAIN_DOCS documents (twice as many at most) of at most TRAIN_CHARS characters, chosen by a hash of the text,
and of TRAIN_TOKENS tokens at most; everything else covers every text whole, in time linear in its length.

Null and empty texts have no spans. A text without white space is one token. Without documents to learn from only base
spans remain. Repeated rows get equal results; extra columns are kept, but for those with the name of an output
column. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.cluster import fresh
from graphloom.llm.scan import scan_text, text_sample
from graphloom.llm.textkit import byte_blocks, per_row

KINDS = ("email", "ip", "card", "phone")
TRAIN_DOCS = 1500
TRAIN_CHARS = 20_000
TRAIN_TOKENS = 100_000
MAX_GAP = 3
MARGINAL = 0.8
#: Share of the base spans that a step of training masks.
MASKED = 0.5
SETTLED = 1e-4
#: The skip potential of equal labels before learning.
AGREE = 1.0
_DIM = 1 << 13
_LABELS = 1 + len(KINDS)

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]++")
# possessive and from the start of a run of digits only: the same matches without quadratic retries
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TOKEN = re.compile(r"\S+")
_OPEN = re.compile(r"[0-9@]")


def _emails(text: str) -> list[tuple[int, int]]:
    """Around each '@': the run of name characters before it, after the last match, and the domain behind."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        if at > last:
            tail = _LOCAL_END.match(text[last:at][::-1])
            start = at - (tail.end() if tail else 0)
        m = _DOMAIN.match(text, at + 1) if start < at else None
        # what lies before this '@' can't be part of a later name
        last = m.end() if m else at + 1
        if m:
            out.append((start, last))
        at = text.find("@", last)
    return out


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _number(part: str) -> bool:
    return int(part.lstrip("0")[:4] or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in order of kinds, then starts; ends are exclusive."""
    out = [(0, s, e) for s, e in _emails(text)]
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(_number(x) for x in m.group().split("."))]
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and _luhn(digits):
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= sum("0" <= c <= "9" for c in m.group()) <= 15]
    return out


def _shape(token: str) -> str:
    s = re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]{5,}", "N", re.sub(r"\d(?=\d{0,3}(?!\d))", "9", token)))
    return re.sub(r"[^\x00-\x7f]+", "u", s)


@lru_cache(50_000)
def _id(kind: str, value: str) -> int:
    return crc32(f"{kind}{value}".encode()) % _DIM


@lru_cache(50_000)
def _beside(piece: str) -> str:
    """The shape of what stands next to a token; its place where nothing does."""
    return _shape(piece) if piece else "^"


@lru_cache(50_000)
def _facts(word: str) -> tuple[tuple[int, ...], tuple[str, ...]]:
    """(ids of a token's own features, keys that like tokens share)."""
    digits, plain, name = re.sub(r"[^0-9]", "", word), re.sub(r"[\W_]+", "", word).lower(), word.split("@")[0].lower()
    ids = (crc32(f"s{_shape(word)}".encode()) % _DIM, _id("n", str(min(len(digits), 20))), _id("l", str(min(len(word), 30) // 3)), _id("@", f"{'@' in word}{'.' in word}"))
    keys = (f"w{plain}" if len(plain) > 3 else "", f"d{digits[-7:]}" if len(digits) >= 7 else "", f"m{name}" if len(name) > 3 else "")
    return ids, tuple(k for k in keys if k)


@dataclass
class Graph:
    """The tokens of many texts as one graph: spans, their text's number, feature ids, base labels, the base span of each (-1: none),
    whether a token without one matches a pattern by itself, and edges by kind."""

    spans: list[tuple[int, int]]
    doc: list[int]
    features: np.ndarray
    label: np.ndarray
    span: np.ndarray
    alone: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def build(texts: list[str], base: list[list[tuple[int, int, int]]], most: int | None = None) -> Graph:
    """The graph of texts with their base spans; of the first texts that have most tokens together, if that is given."""
    spans, docs, features, labels, owner, chain, skip = [], [], [], [], [], [], []
    words: list[str] = []
    n_spans = 0
    for doc, (text, found) in enumerate(zip(texts, base, strict=True)):
        if most is not None and len(spans) >= most:
            break
        begin, links = len(spans), defaultdict(lambda: -1)
        for m in _TOKEN.finditer(text):
            word = m.group()
            if not _OPEN.search(word):
                continue
            word = word.rstrip(".,;:!?)]}\"'")
            start = m.start() + len(word) - len(word := word.lstrip("([{\"'") or word)
            end = start + len(word)
            if not word:
                continue
            i = len(spans)
            spans.append((start, end))
            docs.append(doc)
            words.append(word)
            before, after = text[max(0, start - 12) : start].split(), text[end : end + 12].split()
            ids, keys = _facts(word) if len(word) < 64 else _facts.__wrapped__(word)
            b, a = _beside(before[-1][-4:] if before else ""), _beside(after[0][:4] if after else "")
            features.append((*ids, _id("b", b), _id("a", a), _id(f"p{word[0] if not word[0].isalnum() else 'x'}", b), _id("bias", "")))
            if i > begin and start - spans[i - 1][1] <= MAX_GAP:
                chain.append((i - 1, i))
            for key in keys:
                if links[key] >= 0:
                    skip.append((links[key], i))
                links[key] = i
        mine, whose = [0] * (len(spans) - begin), [-1] * (len(spans) - begin)
        starts = [s for s, _ in spans[begin:]]
        for s, e, k in sorted((s, e, k) for k, s, e in found):
            i = max(0, bisect_right(starts, s) - 1)
            while i < len(starts) and starts[i] < e:
                if spans[begin + i][1] > s and not mine[i]:
                    mine[i], whose[i] = k + 1, n_spans
                i += 1
            n_spans += 1
        labels += mine
        owner += whose
    alone = [not k and bool(base_spans(w)) for k, w in zip(labels, words, strict=True)]
    pairs = lambda x: np.array(sorted(set(x)), np.int64).reshape(-1, 2)
    return Graph(spans, docs, np.array(features, np.int64).reshape(-1, 8), np.array(labels, np.int64), np.array(owner, np.int64), np.array(alone, bool), pairs(chain), pairs(skip))


def _softmax(x: np.ndarray) -> np.ndarray:
    q = np.exp(x - x.max(1, keepdims=True))
    return q / q.sum(1, keepdims=True)


class SkipChainCRF:
    """Log potentials of features (unary), chain edges and skip edges."""

    def __init__(self) -> None:
        self.unary = np.zeros((_DIM, _LABELS))
        self.chain = np.zeros((_LABELS, _LABELS))
        self.skip = AGREE * np.eye(_LABELS)

    def fit(self, g: Graph, steps: int = 60, rate: float = 0.3, decay: float = 1e-4, masked: float = MASKED, seed: int = 19) -> SkipChainCRF:
        """Loopy conditional likelihood of masked base spans and of open tokens, by Adagrad; what the texts say nothing of stays
        at its start (zero, for skip edges AGREE)."""
        n = len(g.label)
        if not n:
            return self
        rng = np.random.default_rng(seed)
        known = np.where(g.alone, -1, g.label)  # -1: latent
        parts = {"unary": self.unary, "chain": self.chain, "skip": self.skip}
        start = {k: v.copy() for k, v in parts.items()}
        squares = {k: np.full_like(v, 1e-6) for k, v in parts.items()}
        for _ in range(steps):
            hidden = rng.random(int(g.span.max()) + 2)[g.span] < masked
            clamped = np.where((g.label > 0) & ~hidden, g.label, -1)
            wanted, free = self._expected(g, known), self._expected(g, clamped)
            for k, v in parts.items():
                d = (free[k] - wanted[k]) / n + decay * (v - start[k])
                squares[k] += d * d
                v -= rate * d / np.sqrt(squares[k])
        return self

    def _expected(self, g: Graph, clamp: np.ndarray) -> dict[str, np.ndarray]:
        """Expected counts of features and of pairs on edges with the nodes clamped where clamp isn't -1."""
        belief, message, back = self._pass(g, clamp, 25)
        q = _softmax(belief)
        unary = np.stack([np.bincount(g.features.ravel(), np.repeat(q[:, k], g.features.shape[1]), _DIM) for k in range(_LABELS)], 1)
        out = {"unary": unary}
        at = 0
        for name, edges, potential in (("chain", g.chain, self.chain), ("skip", g.skip, self.skip)):
            m = len(edges)
            ahead = slice(at, at + m)
            a, b = edges[:, 0], edges[:, 1]
            both = (belief[a] - message[back[ahead]])[:, :, None] + potential + (belief[b] - message[ahead])[:, None, :]
            both = np.exp(both - both.max((1, 2), keepdims=True)) if m else both
            total = (both / both.sum((1, 2), keepdims=True)).sum(0) if m else np.zeros((_LABELS, _LABELS))
            # like tokens have no order
            out[name] = (total + total.T) / 2 if name == "skip" else total
            at += 2 * m
        return out

    def _pass(self, g: Graph, clamp: np.ndarray, most: int, settled: float = SETTLED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sum-product messages, damped after the first rounds, until none changes by settled, or most rounds: (beliefs, messages, place of each one's reverse)."""
        local = self.unary[g.features].sum(1)
        fixed = clamp >= 0
        local[fixed] = -30.0
        local[fixed, clamp[fixed]] = 30.0
        source = np.concatenate([g.chain[:, 0], g.chain[:, 1], g.skip[:, 0], g.skip[:, 1]])
        target = np.concatenate([g.chain[:, 1], g.chain[:, 0], g.skip[:, 1], g.skip[:, 0]])
        c, s = len(g.chain), len(g.skip)
        potential = np.stack([self.chain, self.chain.T, self.skip, self.skip.T])
        kind = np.repeat(np.arange(4), [c, c, s, s])
        back = np.concatenate([np.arange(c) + c, np.arange(c), np.arange(s) + 2 * c + s, np.arange(s) + 2 * c])
        message = np.zeros((len(source), _LABELS))
        belief = local
        active = np.arange(len(source))  # only edges from nodes that a message changed are passed again
        for k in range(most):
            if not len(active):
                break
            out = (belief[source[active]] - message[back[active]])[:, :, None] + potential[kind[active]]
            top = out.max(1, keepdims=True)
            new = np.log(np.exp(out - top).sum(1)) + top[:, 0]
            new -= new.max(1, keepdims=True)
            # a chain settles by itself; what still swings after a while is on loops
            step = (new - message[active]) * (1.0 if k < 12 else 0.5)
            message[active] += step
            for x in range(_LABELS):
                belief[:, x] += np.bincount(target[active], step[:, x], len(belief))
            changed = np.zeros(len(belief), bool)
            changed[target[active[np.abs(step).max(1) >= settled]]] = True
            active = np.flatnonzero(changed[source])
        return belief, message, back

    def marginals(self, g: Graph, rounds: int | None = None) -> np.ndarray:
        """Loopy sum-product over all texts of g at once, damped; clamped where a base label is.

        It goes on until no message changes by SETTLED; where messages keep swinging, for 200 rounds more than the longest text has tokens.
        """
        most = rounds if rounds is not None else 200 + int(np.bincount(g.doc).max())
        return _softmax(self._pass(g, np.where(g.label > 0, g.label, -1), most, SETTLED if rounds is None else 0.0)[0])

    def added(self, texts: list[str], base: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
        """For each text the spans that the field adds; neighbours of one kind within MAX_GAP become one."""
        g = build(texts, base)
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        if not len(g.label) or not self.unary.any():
            return out
        q = self.marginals(g)
        for i in np.flatnonzero((g.label == 0) & (q[:, 1:].max(1) >= MARGINAL)):
            (start, end), kind, mine = g.spans[i], int(q[i, 1:].argmax()), out[g.doc[i]]
            if mine and mine[-1][0] == kind and 0 <= start - mine[-1][2] <= MAX_GAP and not any(s < start and e > mine[-1][2] for _, s, e in base[g.doc[i]]):
                mine[-1] = (kind, mine[-1][1], end)
            else:
                mine.append((kind, start, end))
        return out


def train(docs: DataFrame, text: str = "text", max_docs: int = TRAIN_DOCS, max_chars: int = TRAIN_CHARS, max_tokens: int = TRAIN_TOKENS) -> SkipChainCRF:
    """Learn from about max_docs texts (twice as many at most) of at most max_chars characters that hold a digit or '@'."""
    column = F.col(f"`{text}`")
    some = docs.select(column.alias("text")).where(column.rlike("[0-9@]") & (F.length("text") <= max_chars))
    # by a hash, so that a bound on tokens takes no order of the alphabet
    texts = sorted((r.text for r in text_sample(some, "text", max_docs, seed=5).collect()), key=lambda x: (crc32(x.encode()), x))
    return SkipChainCRF().fit(build(texts, [base_spans(x) for x in texts], max_tokens))


def _render(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


_NONE = sha256(b"").hexdigest()


def _scan(column: pa.Array, model: SkipChainCRF):
    """(row, text, base, added) of the rows that hold a digit or '@'; the others have no span."""
    for first, raw, off in byte_blocks(column):
        rows = np.flatnonzero(per_row(off, ((raw >= 48) & (raw <= 57)) | (raw == 64)))
        texts = [column[first + int(r)].as_py() for r in rows]
        base = [base_spans(x) for x in texts]
        yield from zip((first + rows).tolist(), texts, base, model.added(texts, base), strict=True)


FIELDS = "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint"


def find(docs: DataFrame, text: str = "text", keep: list[str] | None = None, model: SkipChainCRF | None = None, **training) -> DataFrame:
    """The kept columns of docs with the counts and digest of the base spans, all spans, and n_added."""
    model = model or train(docs, text, **training)

    def fields(column: pa.Array) -> list:
        n = len(column)
        counts, digest, spans, extra = np.zeros((4, n), np.int64), [_NONE] * n, [""] * n, np.zeros(n, np.int64)
        for i, _, base, added in _scan(column, model):
            for k, _, _ in base:
                counts[k, i] += 1
            digest[i] = sha256(_render(base).encode()).hexdigest()
            spans[i], extra[i] = _render(base + added), len(added)
        return [*(pa.array(c, pa.int64()) for c in counts), pa.array(digest, pa.string()), pa.array(spans, pa.string()), pa.array(extra, pa.int64())]

    return scan_text(docs, text, FIELDS, fields, keep)


def redact_text(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Each maximal run of overlapping spans becomes the upper-case name of its first span's kind in brackets."""
    out, at = [], 0
    for s, e, k in sorted((s, e, k) for k, s, e in spans):
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text: str = "text", model: SkipChainCRF | None = None, **training) -> DataFrame:
    """docs with the spans of their texts replaced; all rows and columns stay."""
    model = model or train(docs, text, **training)
    name = fresh("redacted", docs.columns)

    def fields(column: pa.Array) -> list:
        made = {i: redact_text(x, base + added) for i, x, base, added in _scan(column, model) if base or added}
        return [pa.array([made.get(i) for i in range(len(column))], pa.string())]

    done = scan_text(docs, text, f"`{name}` string", fields)
    return done.select(*[F.coalesce(F.col(f"`{name}`"), F.col(f"`{c}`")).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])
