"""Vectorised text primitives over Arrow string columns.

Every function works on whole texts. Memory is bounded by working through an Arrow array in blocks of
about BLOCK bytes; only a single text longer than that makes a larger block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa

BLOCK = 1 << 18
_LONG_WORD = 4096
_P = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_tables: dict[str, np.ndarray] = {}


def byte_blocks(column: pa.Array, block: int = BLOCK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yield (first row, bytes, offsets) for runs of rows; offsets has one entry more than the run has rows. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.cast(pa.large_binary()).fill_null(b"")
    n = len(values)
    if not n:
        return
    _, offsets, data = values.buffers()
    off = np.frombuffer(offsets, np.int64)[values.offset : values.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(off, off[row] + block, "right")) - 1
        end = min(max(end, row + 1), n)
        yield row, raw[off[row] : off[end]], off[row : end + 1] - off[row]
        row = end


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    """A-Z to a-z; every other byte as it is."""
    return np.where((raw >= 65) & (raw <= 90), raw | 32, raw)


def is_nonspace(raw: np.ndarray) -> np.ndarray:
    """Bytes of words `[^\\x20\\x09-\\x0D]+`."""
    return (raw != 32) & ((raw < 9) | (raw > 13))


def is_alnum_lower(raw: np.ndarray) -> np.ndarray:
    """Bytes of words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` (of lower-cased text)."""
    return ((raw >= 48) & (raw <= 57)) | ((raw >= 97) & (raw <= 122)) | (raw >= 128)


@dataclass
class Words:
    """The words of a block: byte spans, the row of each, and first[i]:first[i + 1] the words of row i."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def find_words(mask: np.ndarray, offsets: np.ndarray) -> Words:
    """Maximal runs of mask that don't cross rows."""
    n = len(mask)
    before = np.empty(n, bool)
    if n:
        before[0] = False
        before[1:] = mask[:-1]
        inner = offsets[1:-1]
        before[inner[inner < n]] = False
    starts = np.flatnonzero(mask & ~before)
    after = np.empty(n, bool)
    if n:
        after[-1] = False
        after[:-1] = mask[1:]
        inner = offsets[1:-1]
        after[inner[inner > 0] - 1] = False
    ends = np.flatnonzero(mask & ~after) + 1
    return Words(starts, ends, np.searchsorted(starts, offsets, "left"))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_tables.get("up", ())) < n:
        m = max(n, BLOCK + 4096)
        up, down, inverse = np.ones(m, np.uint64), np.ones(m, np.uint64), pow(_P, -1, 1 << 64)
        filled = 1
        while filled < m:
            k = min(filled, m - filled)
            up[filled : filled + k] = up[:k] * np.uint64(pow(_P, filled, 1 << 64))
            down[filled : filled + k] = down[:k] * np.uint64(pow(inverse, filled, 1 << 64))
            filled += k
        _tables["up"], _tables["down"] = up, down
    return _tables["up"], _tables["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span; spans are in order of their starts. Long spans are hashed one by one."""
    out = np.zeros(len(starts), np.uint64)
    lengths = ends - starts
    short = np.flatnonzero(lengths <= _LONG_WORD)
    for i in np.flatnonzero(lengths > _LONG_WORD):
        out[i] = int.from_bytes(blake2b(raw[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    at = 0
    while at < len(short):
        base = starts[short[at]]
        stop = int(np.searchsorted(starts[short], base + BLOCK, "left"))
        part = short[at : max(stop, at + 1)]
        s, e = starts[part] - base, ends[part] - base
        size = int(e.max()) if len(e) else 0
        up, down = _powers(size + 1)
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum((raw[base : base + size].astype(np.uint64) + np.uint64(1)) * up[:size], out=sums[1:])
        out[part] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        at = max(stop, at + 1)
    return out


def gram_weights(k: int) -> np.ndarray:
    return mix(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive values, across rows too; len(words) - k + 1 of them."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, k * 0xA24BAED4963EE407 & _MASK, np.uint64)
    for j, w in enumerate(gram_weights(k)):
        out += words[j : j + n] * w
    return mix(out)


def row_grams(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(start word, hash) of each k-gram that stays within a row."""
    grams = gram_hashes(words, k)
    if not len(grams):
        return np.zeros(0, np.int64), grams
    starts = np.arange(len(grams))
    row_end = np.repeat(first[1:], np.diff(first))[: len(grams)]
    ok = starts + k <= row_end
    return starts[ok], grams[ok]


def covered(length: int, starts: np.ndarray, size: int) -> np.ndarray:
    """Mask of the positions in any [start, start + size)."""
    if not len(starts):
        return np.zeros(length, bool)
    change = np.zeros(length + 1, np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + size, length), -1)
    return np.cumsum(change[:-1]) > 0


def per_row(first: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """How many of first[i]:first[i + 1] are set in mask, for each row."""
    sums = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]


def repeats(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(later, any): which items equal an earlier one of their row, and which have an equal at all."""
    order = np.lexsort((hashes, rows))
    same = np.zeros(len(order) + 1, bool)
    if len(order):
        r, h = rows[order], hashes[order]
        same[1:-1] = (r[1:] == r[:-1]) & (h[1:] == h[:-1])
    later, either = np.zeros(len(order), bool), np.zeros(len(order), bool)
    later[order] = same[:-1]
    either[order] = same[:-1] | same[1:]
    return later, either
