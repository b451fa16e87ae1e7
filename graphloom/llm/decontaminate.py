"""Benchmark decontamination by a broadcast set of normalised n-grams of the test items.

Texts are lower-cased (A-Z) and split into words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`. A window is N consecutive
words of an item; an item of fewer words, but not none, is one window. Each training text is hashed window by
window, looked up in the set, and a hit is verified on the words themselves.

The set is held as sorted arrays (hashes, places of the words in one buffer, and the items of each different window
once), WINDOW_BYTES for each word of an item beside its text. It is broadcast in parts of at most PART_BYTES of that built
size, and at most PARTS of them at once; a larger benchmark is scanned in further passes, with a written table between
them, whose broadcasts are released after each, so that no broadcast grows with it. Items of more than PIECE words are
dealt in pieces that share N - 1 words.

Null, empty and wordless texts have no words and no hits; null and wordless items have no windows. An item
without an id marks words but isn't counted as an item. Repeated rows are judged each by itself, items by their
ids as strings. Empty tables give empty or unhit results. Extra columns don't matter.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.cluster import fresh, written
from graphloom.llm.scan import scan_text
from graphloom.llm.textkit import byte_blocks, covered, find_words, is_alnum_lower, lower_ascii, per_row, row_grams, span_hashes

N = 10
PART_BYTES = 32 << 20
PARTS = 2
WINDOW_BYTES = 32
PIECE = 100_000
_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_STATE = "struct<runs:array<struct<at:bigint,size:int>>,items:array<string>>"
_STATE_TYPE = pa.struct([("runs", pa.list_(pa.struct([("at", pa.int64()), ("size", pa.int32())]))), ("items", pa.list_(pa.string()))])


class NgramSet:
    """Different windows of items in order of their hash: places of their words in a buffer, and the items that have them."""

    def __init__(self, items: list[tuple[str | None, str]], n: int) -> None:
        self.names = [name for name, _ in items]
        self.tables: dict[int, tuple[np.ndarray, ...]] = {}
        pieces = []
        texts = pa.array([t for _, t in items], pa.string())
        for _, raw, off in byte_blocks(texts, 1 << 62):
            raw = lower_ascii(raw)
            w = find_words(is_alnum_lower(raw), off)
            # words one blank apart, so that a window is one run of bytes
            gap = np.zeros(len(raw) + 1, bool)
            gap[w.ends] = True
            keep = is_alnum_lower(raw)
            buffer = np.where(keep, raw, 32)[keep | gap[:-1]]
            place = np.concatenate(([0], np.cumsum(keep | gap[:-1])))
            starts, ends = place[w.starts].astype(np.int32), place[w.ends].astype(np.int32)
            pieces.append(buffer)
            hashes = span_hashes(raw, w.starts, w.ends)
            sizes = np.diff(w.first)
            for size in {min(int(x), n) for x in np.unique(sizes) if x}:
                at, grams = row_grams(hashes, w.first, size)
                row = np.searchsorted(w.first, at, "right") - 1
                ok = sizes[row] >= n if size == n else sizes[row] == size
                at, grams, row = at[ok], grams[ok], row[ok].astype(np.int32)
                order = np.lexsort((row, grams))
                at, grams, row = at[order], grams[order], row[order]
                a, b = starts[at], ends[at + size - 1]
                new = np.ones(len(at), bool)
                for i in np.flatnonzero(grams[1:] == grams[:-1]):
                    new[i + 1] = buffer[a[i] : b[i]].tobytes() != buffer[a[i + 1] : b[i + 1]].tobytes()
                if not new.all() and len(at) > 2:
                    new = self._split_collisions(buffer, grams, a, b, new)
                first = np.flatnonzero(new)
                self.tables[size] = (grams[first], a[first], b[first], np.concatenate((first, [len(at)])).astype(np.int64), row)
        self.buffer = np.concatenate(pieces) if pieces else np.zeros(0, np.uint8)

    @staticmethod
    def _split_collisions(buffer, grams, a, b, new):
        """Different words under one hash needn't stand together; where that happens each occurrence is a window of its own."""
        run = np.concatenate(([True], grams[1:] != grams[:-1]))
        mixed = np.add.reduceat(new & ~run, np.flatnonzero(run)) > 0
        return new | np.repeat(mixed, np.diff(np.concatenate((np.flatnonzero(run), [len(grams)]))))

    def hits(self, raw: np.ndarray, w, hashes: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
        """(start word, size, items) of every window found in a block of texts."""
        out = []
        for size, (known, a, b, cut, row) in self.tables.items():
            starts, grams = row_grams(hashes, w.first, size)
            if not len(grams):
                continue
            left = np.searchsorted(known, grams)
            for i in np.flatnonzero(known[np.minimum(left, len(known) - 1)] == grams):
                words = _words(raw, w, int(starts[i]), size)
                k, found = int(left[i]), []
                while k < len(known) and known[k] == grams[i]:
                    if self.buffer[a[k] : b[k]].tobytes() == words:
                        found.append(row[cut[k] : cut[k + 1]])
                    k += 1
                if found:
                    out.append((int(starts[i]), size, found[0] if len(found) == 1 else np.concatenate(found)))
        return out


def _words(raw: np.ndarray, w, at: int, size: int) -> bytes:
    return b" ".join(raw[w.starts[i] : w.ends[i]].tobytes() for i in range(at, at + size))


def _find(sets: list, earlier: list | None, texts: pa.Array) -> list[dict]:
    """For each text its hit windows (start word, size) and the different items that have them."""
    out: list[dict] = []
    for row, raw, off in byte_blocks(texts):
        raw = lower_ascii(raw)
        w = find_words(is_alnum_lower(raw), off)
        hashes = span_hashes(raw, w.starts, w.ends)
        runs: list[set] = [set() for _ in range(len(off) - 1)]
        items: list[set] = [set() for _ in range(len(off) - 1)]
        for one in sets:
            rows: list[dict[int, np.ndarray]] = [{} for _ in range(len(off) - 1)]  # by id, so that a window's items are read once a text
            for start, size, found in one.hits(raw, w, hashes):
                r = int(np.searchsorted(w.first, start, "right")) - 1
                runs[r].add((start - int(w.first[r]), size))
                rows[r][found.__array_interface__["data"][0]] = found
            for r, groups in enumerate(rows):
                if groups:
                    items[r].update(one.names[i] for i in np.unique(np.concatenate(list(groups.values()))).tolist())
        for r in range(len(off) - 1):
            before = earlier[row + r] if earlier is not None else None
            if before:
                runs[r].update((x["at"], x["size"]) for x in before["runs"] or ())
                items[r].update(before["items"] or ())
            out.append({"runs": [{"at": a, "size": s} for a, s in sorted(runs[r])], "items": sorted(items[r] - {None})})
    return out


def _report(texts: pa.Array, hits: list[dict]) -> list:
    """n_words, n_hit, n_items, items_sha256, contaminated, spans (code points of the hit runs)."""
    cols: list[list] = [[], [], [], [], [], []]
    for row, raw, off in byte_blocks(texts):
        low = lower_ascii(raw)
        w = find_words(is_alnum_lower(low), off)
        starts = [int(w.first[r]) + h["at"] for r in range(len(off) - 1) for h in hits[row + r]["runs"]]
        sizes = [h["size"] for r in range(len(off) - 1) for h in hits[row + r]["runs"]]
        mask = np.zeros(len(w.starts), bool)
        for size in set(sizes):
            mask |= covered(len(mask), np.array([s for s, k in zip(starts, sizes, strict=True) if k == size], np.int64), size)
        n_hit = per_row(w.first, mask)
        for r in range(len(off) - 1):
            a, b = int(w.first[r]), int(w.first[r + 1])
            items = sorted(hits[row + r]["items"])
            spans = []
            if n_hit[r]:
                points = np.zeros(off[r + 1] - off[r] + 1, np.int64)
                np.cumsum((raw[off[r] : off[r + 1]] & 0xC0) != 0x80, out=points[1:])
                edge = np.diff(np.concatenate(([0], mask[a:b].astype(np.int8), [0])))
                for s, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
                    spans.append({"start": int(points[w.starts[a + s] - off[r]]), "end": int(points[w.ends[a + e - 1] - off[r]])})
            for c, v in zip(cols, (b - a, int(n_hit[r]), len(items), sha256(",".join(items).encode()).hexdigest(), bool(n_hit[r]), spans), strict=True):
                c.append(v)
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
    return [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]


FIELDS = "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, hit_spans array<struct<start:bigint,end:bigint>>"


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", n: int = N, part_bytes: int = PART_BYTES, parts: int = PARTS, piece: int = PIECE) -> DataFrame:
    """docs with n_words, n_hit, n_items, items_sha256, contaminated and hit_spans (code points); see the module."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item).cast("string").alias("item"), F.col(item_text).alias("text")).where("text is not null").distinct()
    # items that are longer than a piece, dealt in pieces that share all but the first word of a window
    words = F.regexp_extract_all(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(_WORDS), F.lit(0))
    cuts = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - (n - 1)), F.lit(piece)), lambda a: F.array_join(F.slice("words", a, piece + n - 1), " "))
    pieces = items.withColumn("words", words).select("item", F.explode(F.when(F.size("words") > piece + n, cuts).otherwise(F.array("text"))).alias("text"), F.least(F.size("words"), F.lit(piece + n)).alias("n"))
    pieces = pieces.withColumn("built", F.octet_length("text") + F.col("n") * WINDOW_BYTES + 64)
    size = pieces.agg(F.sum("built").alias("b")).first().b or 0
    # dealt by a hash, so parts differ in size; they are planned at half of the bound
    count = max(1, -(-2 * size // part_bytes))
    dealt = pieces.select("item", "text", F.pmod(F.xxhash64("item", "text"), F.lit(count)).alias("part"))
    if count > 1:
        dealt = written(dealt, "part")
    groups = [list(range(at, min(at + parts, count))) for at in range(0, count, parts)]
    state = fresh("hits", docs.columns)
    for k, group in enumerate(groups):
        sets = [spark.sparkContext.broadcast(NgramSet([(r.item, r.text) for r in dealt.where(F.col("part") == p).collect()], n)) for p in group]
        if len(groups) == 1:
            return scan_text(docs, text, FIELDS, lambda t, s=sets: _report(t, _find([b.value for b in s], None, t)))
        docs = _pass(docs, text, state, sets, first=k == 0)
        if k < len(groups) - 1:
            docs = written(docs)
            for one in sets:
                one.destroy()
    return _finish(docs, text, state, [c for c in docs.columns if c != state])


def _pass(docs: DataFrame, text: str, state: str, sets: list, first: bool) -> DataFrame:
    if first:
        return scan_text(docs, text, f"`{state}` {_STATE}", lambda t: [pa.array(_find([b.value for b in sets], None, t), _STATE_TYPE)])
    schema = docs.schema

    def run(batches):
        for batch in batches:
            t, before = batch.column(schema.names.index(text)), batch.column(schema.names.index(state))
            after = pa.array(_find([b.value for b in sets], before.to_pylist(), t), _STATE_TYPE)
            yield pa.RecordBatch.from_arrays([after if name == state else c for name, c in zip(schema.names, batch.columns, strict=True)], names=schema.names)

    return docs.mapInArrow(run, schema)


def _finish(docs: DataFrame, text: str, state: str, kept: list[str]) -> DataFrame:
    from pyspark.sql import types as T

    new = T.StructType.fromDDL(FIELDS)
    kept = [c for c in kept if c not in new.names]
    out = T.StructType([docs.schema[c] for c in kept] + new.fields)
    names = docs.schema.names

    def run(batches):
        for batch in batches:
            made = _report(batch.column(names.index(text)), batch.column(names.index(state)).to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(names.index(c)) for c in kept), *made], names=out.names)

    return docs.mapInArrow(run, out)


def without_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", remove: str = "documents", **options) -> DataFrame:
    """docs with the columns they had, less their contaminated documents, or (remove='spans') less the hit words' spans."""
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text}`").alias("text"))
    judged = decontaminate(inner, benchmark, "text", **options)
    if remove == "documents":
        return judged.where("not contaminated").select("row.*")
    pieces = F.aggregate(
        "hit_spans",
        F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at")),
        lambda s, x: F.struct(F.concat(s["out"], F.substring(F.col("text"), (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int"))).alias("out"), x["end"].alias("at")),
    )
    done = judged.withColumn("piece", pieces).withColumn("left", F.when(F.size("hit_spans") > 0, F.concat(F.col("piece.out"), F.expr("substring(text, cast(piece.at + 1 as int))"))).otherwise(F.col("text")))
    return done.select(*[F.col("left").alias(c) if c == text else F.col(f"row.`{c}`") for c in docs.columns])
