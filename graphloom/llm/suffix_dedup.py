"""Removal of repeated byte strings by suffix arrays built in two stages.

Every byte that a WINDOW-byte string covers is removed if that string also starts anywhere else, in the same text or
another; strings are judged on the input. The result is exact up to 64-bit hashes of texts and of segments.

1. The smallest hash of the K-grams of a window (its minimizer) depends on the window alone, so equal windows have
   equal minimizers. A maximal run of window starts with one minimizer is a segment, about 70 starts long; a window
   that repeats does so among the segments of its minimizer.
2. Segments travel as packed arrays to a bucket of their minimizer. Equal segments within a block of texts are
   settled there and sent on once, so that a passage that a third of all texts share is a row per block. A minimizer that is
   met once is done. A segment met twice is repeated as a whole. Segments of a very common minimizer (a share of COMMON or more
   of all texts, found by counts within blocks; few, so they are broadcast) are dealt by their content instead, so that
   no bucket gathers a row for each text around a passage.
3. What is left are minimizers with different segments: ends of shared passages, mostly. Their bytes are sorted by a
   two-stage suffix array (Itoh and Tanaka, 1999): suffixes smaller than their successor are sorted directly, the
   others induced from them by one scan over the buckets of first bytes. Neighbours with a common prefix of WINDOW
   bytes mark windows that repeat. A minimizer with more than CHUNK different segments is dealt into chunks, each
   with an array of its own; windows that no neighbour of their chunk settles are matched between chunks by
   their hashes, one row for each chunk and window.

Equal texts are told by a hash and count as repeats of each other from WINDOW bytes on. Null texts are empty; texts of
fewer bytes than WINDOW lose nothing. Repeated rows get equal results. Extra columns don't matter. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.cluster import drop, written
from graphloom.llm.scan import scan_text
from graphloom.llm.textkit import _powers, byte_blocks, mix
from graphloom.shipping import ship

WINDOW = 200
K = 64
CHUNK = 2048
COMMON = 0.002
_COMMON_LEAST = 64  # different segments of a block; below, a minimizer is not worth a row of counts
_PIECE = 1 << 22
_BLOCK_SEGMENTS = 1 << 19
_BATCH_BYTES = 1 << 21
_PARTS = 4096  # chunks of one common minimizer in a bucket


def text_key(raw: np.ndarray) -> int:
    return int.from_bytes(blake2b(raw.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sliding(x: np.ndarray, w: int, op: np.ufunc, fill: int) -> np.ndarray:
    """op over x[i:i + w] for each i, by running op from both ends of blocks of w."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    blocks = np.full(-(-len(x) // w) * w, fill, x.dtype)
    blocks[: len(x)] = x
    blocks = blocks.reshape(-1, w)
    ahead = op.accumulate(blocks, axis=1).reshape(-1)
    behind = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return op(behind[:n], ahead[w - 1 : w - 1 + n])


def segments(raw: np.ndarray, off: np.ndarray, window: int = WINDOW, k: int = K) -> tuple[np.ndarray, ...]:
    """(row, start, starts in it, minimizer, hash of its bytes, minimizer's places) of each segment of each row."""
    n = len(raw)
    if n < window:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.int64))
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    grams = mix((sums[k:] - sums[:-k]) * down[: n - k + 1])
    wide = window - k + 1
    low = _sliding(grams, wide, np.minimum, (1 << 64) - 1)
    first, last = off[:-1], off[1:] - window  # window starts of a row
    rows = np.flatnonzero(last >= first)
    edge = np.zeros(len(low) + 1, bool)
    edge[1:-1] = low[1:] != low[:-1]
    edge[first[rows]] = True
    edge[last[rows] + 1] = True
    inside = np.zeros(len(low) + 1, np.int32)
    np.add.at(inside, first[rows], 1)
    np.add.at(inside, last[rows] + 1, -1)
    good = np.cumsum(inside[:-1]) > 0
    low = np.where(good, low, 0)
    cuts = np.flatnonzero(edge)
    starts = cuts[:-1] if len(cuts) and cuts[-1] == len(good) else cuts
    ends = np.concatenate((cuts[1:], [len(good)]))[: len(starts)]
    ok = good[starts]
    starts, ends = starts[ok], ends[ok]
    h = low[starts]
    # places of a minimizer: positions whose hash is the least of a window that holds them
    padded = np.concatenate((np.zeros(wide - 1, np.uint64), low, np.zeros(wide - 1, np.uint64)))
    places = np.flatnonzero(grams == _sliding(padded, wide, np.maximum, 0))
    values, name = np.unique(grams[places], return_inverse=True)
    keys = np.sort(name * np.int64(n + 1) + places)
    of = np.searchsorted(values, h) * np.int64(n + 1)
    times = np.searchsorted(keys, of + ends - 1 + wide - 1, "right") - np.searchsorted(keys, of + starts, "left")
    stop = ends - 1 + window
    content = mix((sums[stop] - sums[starts]) * down[starts] + (stop - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    row = np.searchsorted(off, starts, "right") - 1
    return row, starts - off[row], ends - starts, h, content, times


_KINDS = (np.uint64, np.uint64, np.int64, np.uint32, np.uint32, np.uint32, np.uint32)
_DEALT = "kind int, bucket int, blob binary"


def _pack(columns: list[np.ndarray]) -> bytes:
    return np.int64(len(columns[0])).tobytes() + b"".join(np.ascontiguousarray(c, k).tobytes() for c, k in zip(columns, _KINDS, strict=True))


def _unpack(blobs) -> list[np.ndarray]:
    parts: list[list[np.ndarray]] = [[] for _ in _KINDS]
    for blob in blobs:
        n, at = int(np.frombuffer(blob, np.int64, 1)[0]), 8
        for part, kind in zip(parts, _KINDS, strict=True):
            part.append(np.frombuffer(blob, kind, n, at))
            at += part[-1].nbytes
    return [np.concatenate(p) for p in parts]


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal rows, and the end."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.concatenate((np.flatnonzero(new), [n]))


def _segment_blocks(batches: Iterator[pa.RecordBatch], window: int, k: int) -> Iterator[tuple[list[np.ndarray], int]]:
    """([text key, start, starts, minimizer, content, places] in order of minimizer and content, texts) for blocks of texts; a text is taken once in a while, however many copies follow."""
    parts, total, texts, seen = [], 0, 0, set()

    def block() -> tuple[list[np.ndarray], int]:
        columns = [np.concatenate([p[i] for p in parts]) for i in range(6)]
        order = np.lexsort((columns[4], columns[3]))
        return [c[order] for c in columns], texts

    for batch in batches:
        for _, raw, off in byte_blocks(batch.column(0)):
            keys = np.array([text_key(raw[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)], np.int64)
            fresh = np.array([x not in seen and (seen.add(x) or True) for x in keys.tolist()])
            if len(raw) > _PIECE:  # one long text, in pieces that share all but the first byte of a window
                pieces = [(s, raw[s : s + _PIECE + window - 1]) for s in range(0, max(1, len(raw) - window + 1), _PIECE)] if fresh[0] else []
                got = [(s, segments(p, np.array([0, len(p)]), window, k)) for s, p in pieces]
            else:
                got = [(0, segments(raw, off, window, k))]
            if len(seen) > 200_000:
                seen.clear()
            texts += int(fresh.sum())
            for s, (row, start, size, h, content, places) in got:
                ok = fresh[row]
                parts.append((keys[row[ok]], start[ok] + s, size[ok], h[ok], content[ok], places[ok]))
                total += int(ok.sum())
        if total >= _BLOCK_SEGMENTS:
            yield block()
            parts, total, texts = [], 0, 0
    if parts:
        yield block()


def _count_common(window: int, k: int, share: float, least: int):
    """Texts to (minimizer, different segments in a block) of those with at least half of the share of the block's texts."""
    schema = pa.schema([("h", pa.int64()), ("n", pa.int64()), ("texts", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, _, _, h, content, _), texts in _segment_blocks(batches, window, k):
            different = h[_runs(h, content)[:-1]]
            cut = _runs(different)
            n = np.diff(cut)
            often = n >= max(least, share * texts / 2)
            some = different[cut[:-1]][often].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((some, [0]))), pa.array(np.concatenate((n[often], [0]))), pa.array(np.concatenate((np.zeros(len(some), np.int64), [texts])))], schema=schema)

    return run


def common_minimizers(texts: DataFrame, window: int, k: int, share: float, least: int) -> np.ndarray:
    """The minimizers with different segments in half of the share of all texts, by the counts of blocks. Which these are changes
    no result, only the way that segments take. There are fewer than 2 / share times the segments of a mean text."""
    counted = written(texts.mapInArrow(_count_common(window, k, share, least), "h bigint, n bigint, texts bigint"))
    every = counted.agg(F.sum("texts").alias("n")).first().n or 0
    rows = counted.where("n > 0").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= share * every / 2).select("h").toArrow().column(0).to_numpy()
    drop(counted)
    return np.sort(rows.astype(np.int64).view(np.uint64))


def _deal_segments(buckets: int, window: int, k: int, common):
    """Texts to packed segments (kind 0, by bucket of the minimizer, and kind 2, of common minimizers by bucket of the content:
    minimizer, content, text key, start, starts, occurrences, places) and settled ones (kind 1: the same columns, by bucket of the text)."""
    schema = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("blob", pa.binary())])

    def send(kind: int, columns: list[np.ndarray], by: np.ndarray) -> Iterator[pa.RecordBatch]:
        bucket = (by % by.dtype.type(buckets)).astype(np.uint16)
        order = np.argsort(bucket, kind="stable")
        cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(cut)):
            part = order[cut[b] : cut[b + 1]]
            yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([b], pa.int32()), pa.array([_pack([c[part] for c in columns])], pa.binary())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy = common.value
        for (key, start, size, h, content, places), _ in _segment_blocks(batches, window, k):
            runs = _runs(h, content)
            times = np.diff(runs)
            columns = [h, content, key, start, size, np.repeat(times, times), places]
            one = [c[runs[:-1]] for c in columns]
            is_heavy = heavy[np.minimum(np.searchsorted(heavy, one[0]), len(heavy) - 1)] == one[0] if len(heavy) else np.zeros(len(one[0]), bool)
            for kind, some, by in ((0, ~is_heavy, one[0] >> np.uint64(8)), (2, is_heavy, one[1] >> np.uint64(8))):
                if some.any():
                    yield from send(kind, [c[some] for c in one], by[some])
            again = np.repeat(times, times) > 1
            if again.any():
                yield from send(1, [c[again] for c in columns], key[again].astype(np.uint64))

    return run


_FOUND = "kind int, key bigint, start int, size int, h bigint, chunk int, chunks int"


def _settle(chunk: int):
    """One bucket of segments to repeated ones (kind 1) and those that need sorting (kind 2)."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        h, content, text, start, size, times, places = _unpack(pdf["blob"])
        if int(key[0]) == 1:
            return pd.DataFrame({"kind": 1, "key": text, "start": start.astype(np.int32), "size": size.astype(np.int32), "h": 0, "chunk": 0, "chunks": 0})
        order = np.lexsort((start, text, content, h))
        h, content, text, start, size, times, places = (x[order] for x in (h, content, text, start, size, times, places))
        # a text that several tasks saw
        once = _runs(h, content, text, start)[:-1]
        most = np.maximum.reduceat(times, once) if len(once) else times
        h, content, text, start, size, places, times = h[once], content[once], text[once], start[once], size[once], places[once], most
        runs = _runs(h, content)
        first = runs[:-1]
        met = np.add.reduceat(times, first) if len(first) else times  # of each different segment
        whole = np.repeat(met > 1, np.diff(runs))
        groups = _runs(h[first])
        different = np.diff(groups)
        total = np.add.reduceat(met * np.maximum.reduceat(places, first), groups[:-1]) if len(first) else met
        one_left = np.add.reduceat((met == 1).astype(np.int64), groups[:-1]) > 0 if len(first) else np.zeros(0, bool)
        sort = (total > 1) & one_left | (int(key[0]) == 2)  # segments of a common minimizer have others in other buckets
        rows = first[np.repeat(sort, different)]
        chunks = -(-np.repeat(different[sort], different[sort]) // chunk)
        part = ((content[rows] >> np.uint64(20)) % chunks.astype(np.uint64)).astype(np.int64)
        if int(key[0]) == 2:
            part, chunks = part % _PARTS + int(key[1]) * _PARTS, np.full(len(rows), 2)
        a = pd.DataFrame({"kind": 1, "key": text[whole], "start": start[whole].astype(np.int32), "size": size[whole].astype(np.int32), "h": 0, "chunk": 0, "chunks": 0})
        b = pd.DataFrame({"kind": 2, "key": text[rows], "start": start[rows].astype(np.int32), "size": size[rows].astype(np.int32), "h": h[rows].astype(np.int64), "chunk": part.astype(np.int32), "chunks": chunks.astype(np.int32)})
        return pd.concat([a, b], ignore_index=True)

    return run


def suffix_array(text: np.ndarray, depth: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes of a byte string in order, words): the order is right for the first depth bytes at least; equal beyond, suffixes
    stand in any order. words[i] holds the 8 bytes from i on.

    Stage one sorts the suffixes that are smaller than their successor, 8 bytes at a time, as long as there are equal ones.
    Stage two scans the buckets of first bytes upwards: a suffix that is larger than its successor gets its place when
    the successor is met, bucket by bucket; runs of one byte take a wave for each of their bytes.
    """
    n = len(text)
    padded = np.concatenate((text, np.zeros(depth + 16, np.uint8)))
    words = np.zeros(n + depth + 8, np.uint64)
    for j in range(8):
        words = (words << np.uint64(8)) | padded[j : j + len(words)]
    change = np.flatnonzero(text[1:] != text[:-1])
    nearest = np.searchsorted(change, np.arange(n))  # the next position whose successor differs
    smaller = np.zeros(n, bool)
    has = nearest < len(change)
    at = change[nearest[has]]
    smaller[has] = text[at] < text[at + 1]
    # stage one
    direct = np.flatnonzero(smaller)
    direct = direct[np.argsort(words[direct], kind="stable")]
    lo = np.arange(len(direct))
    group = np.cumsum(np.concatenate(([True], words[direct][1:] != words[direct][:-1]))) if len(direct) else lo
    for d in range(8, depth, 8):
        sizes = np.bincount(group, minlength=int(group.max()) + 1 if len(group) else 1)
        tied = sizes[group] > 1
        lo, group = lo[tied], group[tied]
        if not len(lo):
            break
        sub = direct[lo]
        key = words[sub + d]
        order = np.lexsort((key, group))
        direct[lo] = sub[order]
        key, group = key[order], group[order]
        group = np.cumsum(np.concatenate(([True], (key[1:] != key[:-1]) | (group[1:] != group[:-1]))))
    # stage two
    larger = ~smaller
    heads: list[list[np.ndarray]] = [[] for _ in range(256)]
    if n:
        heads[text[n - 1]].append(np.array([n - 1]))
    cut = np.searchsorted(text[direct], np.arange(257)) if len(direct) else np.zeros(257, np.int64)
    out = []
    for c in range(256):
        wave = np.concatenate(heads[c]) if heads[c] else np.zeros(0, np.int64)
        heads[c] = []
        before_parts = []
        while len(wave):
            out.append(wave)
            before = wave[wave > 0] - 1
            before = before[larger[before]]
            same = text[before] == c
            before_parts.append(before[~same])
            wave = before[same]
        part = direct[cut[c] : cut[c + 1]]
        out.append(part)
        before = part[part > 0] - 1
        before_parts.append(before[larger[before]])
        before = np.concatenate(before_parts)
        if len(before):
            first = text[before]
            order = np.argsort(first, kind="stable")
            before, first = before[order], first[order]
            edges = _runs(first)
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                heads[first[a]].append(before[a:b])
    return np.concatenate(out) if out else np.zeros(0, np.int64), words


def repeated_starts(text: np.ndarray, valid: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Mask of the valid starts whose window equals that of another valid start."""
    order, words = suffix_array(text, window)
    order = order[valid[order]]
    x, y = order[:-1], order[1:]
    common = np.zeros(len(x), np.int64)  # of neighbours, in bytes, up to the window
    alive = np.arange(len(x))
    for d in range(0, window, 8):
        same = words[x[alive] + d] ^ words[y[alive] + d]
        if d + 8 > window:
            same >>= np.uint64(8 * (d + 8 - window))
        alive = alive[same == 0]
        common[alive] += min(8, window - d)
    out = np.zeros(len(text), bool)
    hit = common >= window
    out[x[hit]] = True
    out[y[hit]] = True
    return out


_SPANS = "key bigint, start int, size int, wh bigint, h bigint, chunk int"


def _sort_segments(window: int):
    """Segments in order of (h, chunk) to runs of repeated starts (wh null), and for minimizers of several chunks a row
    for each different window: settled ones (size 0) and open ones (size 1)."""
    schema = pa.schema([("key", pa.int64()), ("start", pa.int32()), ("size", pa.int32()), ("wh", pa.int64()), ("h", pa.int64()), ("chunk", pa.int32())])

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        pieces, valid_at, begin = [], [], []
        at = 0
        for _, _, _, _, size, _, raw in rows:
            pieces += [np.frombuffer(raw, np.uint8), np.zeros(1, np.uint8)]
            begin.append(at)
            valid_at.append((at, size))
            at += len(raw) + 1
        text = np.concatenate(pieces)
        valid = np.zeros(len(text), bool)
        for a, size in valid_at:
            valid[a : a + size] = True
        hit = repeated_starts(text, valid, window)
        out: list[list] = [[], [], [], [], [], []]

        def add(*values) -> None:
            for c, v in zip(out, values, strict=True):
                c.append(v)

        told: dict[tuple, set] = {}
        for (h, chunk, chunks, key, size, start, _), a in zip(rows, begin, strict=True):
            mine = hit[a : a + size]
            edge = np.diff(np.concatenate(([0], mine.astype(np.int8), [0])))
            for s, e in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
                add(key, start + s, e - s, None, None, None)
            if chunks > 1:
                known = told.setdefault((h, chunk), set())
                for i in range(size):
                    wh = int.from_bytes(blake2b(text[a + i : a + i + window].tobytes(), digest_size=8).digest(), "little", signed=True)
                    if not mine[i]:
                        add(key, start + i, 1, wh, h, chunk)
                    elif wh not in known:
                        known.add(wh)
                        add(None, None, 0, wh, h, chunk)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, total, last = [], 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if total >= _BATCH_BYTES and row[:2] != last:  # other minimizers share no window, so any cut between them will do
                    yield solve(rows)
                    rows, total = [], 0
                last = row[:2]
                rows.append(row)
                total += len(row[6])
        if rows:
            yield solve(rows)

    return run


def _cut_out(window: int):
    """(text, wanted segments) to a row for each segment with its bytes."""
    schema = pa.schema([("h", pa.int64()), ("chunk", pa.int32()), ("chunks", pa.int32()), ("key", pa.int64()), ("size", pa.int32()), ("start", pa.int32()), ("raw", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = text.encode()
                rows = [(w["h"], w["chunk"], w["chunks"], key, w["size"], w["start"], raw[w["start"] : w["start"] + w["size"] + window - 1]) for w in wanted]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


FIELDS = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _finish(window: int, with_kept: bool):
    """(doc_id, text, whole, spans) to the result; the last column has the bytes that are left, if wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            for text, whole, *lists in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                raw = (text or "").encode()
                if whole and len(raw) >= window:
                    spans = [(0, len(raw))]
                else:
                    spans = _merge([(x["start"], x["start"] + x["size"] + window - 1) for some in lists for x in some or ()])
                at, left = 0, []
                for s, e in spans:
                    left.append(raw[at:s])
                    at = e
                kept = b"".join([*left, raw[at:]])
                for c, v in zip(cols, (len(raw), len(raw) - len(kept), len(spans), sha256(kept).hexdigest(), kept if with_kept else None), strict=True):
                    c.append(v)
            arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def _keys(texts: pa.Array) -> list:
    return [pa.array([text_key(raw[a:b]) for _, raw, off in byte_blocks(texts) for a, b in zip(off[:-1], off[1:], strict=True)], pa.int64())]


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, k: int = K, chunk: int = CHUNK, with_kept: bool = False, common: float = COMMON, common_least: int = _COMMON_LEAST) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and kept (bytes left; null unless wanted): a row for each row of docs."""
    spark = docs.sparkSession
    ship(spark)
    buckets = min(max(64, int(spark.conf.get("spark.sql.shuffle.partitions"))), 60_000)
    texts = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    keyed = scan_text(texts, "text", "key bigint", _keys, ["doc_id", "text"])
    copies = keyed.where(F.octet_length("text") >= window).groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.lit(True).alias("whole"))
    heavy = spark.sparkContext.broadcast(common_minimizers(texts.select("text"), window, k, common, common_least))
    dealt = texts.select("text").mapInArrow(_deal_segments(buckets, window, k, heavy), _DEALT)
    found = written(dealt.groupBy("kind", "bucket").applyInPandas(_settle(chunk), _FOUND))
    spans = found.where("kind = 1").groupBy("key").agg(F.collect_list(F.struct("start", "size")).alias("spans"))
    wanted = found.where("kind = 2").groupBy("key").agg(F.collect_list(F.struct("h", "chunk", "chunks", "start", "size")).alias("wanted"))
    # written, so that the join has a plain exchange on either side and adaptive execution can split the copies of one text
    known = written(copies.join(spans, "key", "full_outer").join(wanted, "key", "full_outer"))
    # the one shuffle of all texts; those with open segments are kept for the second half
    joined = written(keyed.join(known, "key", "left").select("doc_id", "text", "whole", "spans", "wanted", "key"))
    open_texts = joined.where("wanted is not null").groupBy("key").agg(F.first("text").alias("text"), F.first("wanted").alias("wanted"))
    pieces = open_texts.select("key", "text", "wanted").mapInArrow(_cut_out(window), "h bigint, chunk int, chunks int, key bigint, size int, start int, raw binary")
    sorted_ = written(pieces.repartition("h", "chunk").sortWithinPartitions("h", "chunk").mapInArrow(_sort_segments(window), _SPANS))
    windows = sorted_.where("wh is not null")
    across = windows.groupBy("h", "wh").agg(F.min("chunk").alias("lo"), F.max("chunk").alias("hi")).where("lo < hi").select("h", "wh")
    late = windows.where("size = 1").join(across, ["h", "wh"], "left_semi").select("key", "start", "size")
    more = sorted_.where("wh is null").select("key", "start", "size").union(late).groupBy("key").agg(F.collect_list(F.struct("start", "size")).alias("more"))
    settled = joined.where("wanted is null").select("doc_id", "text", "whole", "spans", F.lit(None).cast("array<struct<start:int,size:int>>").alias("more"))
    rest = joined.where("wanted is not null").join(more, "key", "left").select("doc_id", "text", "whole", "spans", "more")
    drop(found)
    drop(known)
    kind = docs.schema[doc_id].dataType.simpleString()
    return settled.union(rest).mapInArrow(_finish(window, with_kept), f"doc_id {kind}, {FIELDS}")
