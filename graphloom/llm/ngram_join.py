"""Near-duplicate groups by an exact n-gram Jaccard join with T-occurrence search (DivideSkip).

A document's set holds its distinct shingles of K lower-cased (A-Z) words, as 64-bit hashes; with fewer words, but
not none, its whole sequence is the one shingle. Two documents link if 100 * |A and B| >= PERCENT * |A or B|, and
groups are the connected components of links. No cap or sample is used anywhere.

1. Documents with equal sets are one class, named by a hash of the set. Classes, not documents, go on.
2. Shingles travel as packed arrays to a bucket of their hash, are counted there, and those that stand in two
   classes or more go back to their class. Very common ones (a share of HEAVY or more of all classes, found by counts within
   batches; fewer than the mean set size / HEAVY * 2, so they are broadcast) don't travel: they go from where they are read to
   their class and stand last in the order, so that no bucket gathers a row for each class that has one. A class of n shingles needs T = ceil(PERCENT% of n) common ones with any
   partner, so one with fewer repeated shingles than T is done: it has no partner. What is left is close to the
   true near-duplicates, and the repeated shingles alone give all overlaps.
3. In order of (frequency, hash), partners share one of the first n - T + 1 shingles of each (its short lists).
   Every class is joined to the smallest class of each such shingle; the components of that graph are blocks, and
   partners never lie in different blocks.
4. Within a block an inverted index answers each class by DivideSkip (Li, Lu and Lu, 2008): the longest lists are
   set aside, the short ones merged by a heap that skips what can't occur often enough, and a class that does is
   probed by binary search in the long lists, until it is sure to reach the overlap or to miss it.
5. A block of more than CHUNK classes is dealt into chunks. First each class is searched among its leaders from
   step 3, which joins most of a large family; then the classes outside the block's largest family are queries
   against all its chunks, in blocks of CHUNK queries. So no task holds a large block, pairs within a family are not
   enumerated, and still every link between two families is found.

Null, empty and wordless texts have no shingles and link with nothing. Rows with a null id count for links and get the
smallest id of their group, or null. Repeated rows are in one group. Extra columns don't matter. An empty table gives
an empty result. Classes are told apart by 64 bits: two of them are taken for one with a probability of c * c / 2**65.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.cluster import connected_components, drop, fresh, written
from graphloom.llm.scan import scan_text
from graphloom.llm.textkit import byte_blocks, find_words, gram_hashes, is_nonspace, lower_ascii, row_grams, span_hashes
from graphloom.shipping import ship

K = 4
PERCENT = 85
CHUNK = 1024
BUCKET_BYTES = 48 << 20
HEAVY = 0.002
_HEAVY_LEAST = 16  # classes of a block of texts; below, a shingle is not worth a row of counts
_MU = 0.0085  # of the paper: how much probing a list costs against merging it
_BLOCK_TOKENS = 1 << 21


def shingle_sets(texts: pa.Array, k: int = K) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle hashes."""
    for _, raw, off in byte_blocks(texts):
        low = lower_ascii(raw)
        w = find_words(is_nonspace(low), off)
        hashes = span_hashes(low, w.starts, w.ends)
        starts, grams = row_grams(hashes, w.first, k)
        cut = np.searchsorted(starts, w.first)
        for r in range(len(off) - 1):
            a, b = int(w.first[r]), int(w.first[r + 1])
            yield np.unique(grams[cut[r] : cut[r + 1]]) if b - a >= k or a == b else gram_hashes(hashes[a:b], b - a)


def signature(tokens: np.ndarray) -> int | None:
    return int.from_bytes(blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True) if len(tokens) else None


def _sizes(k: int):
    def fields(texts: pa.Array) -> list:
        n, sig = [], []
        for x in shingle_sets(texts, k):
            n.append(len(x))
            sig.append(signature(x))
        return [pa.array(n, pa.int64()), pa.array(sig, pa.int64())]

    return fields


_COUNTS = pa.list_(pa.struct([("token", pa.int64()), ("n", pa.int64())]))


def _sizes_and_common(k: int, share: float, least: int, names: list[str]):
    """Rows (id, text) to names: id, n_shingles, sig, and common, which is null but on the last row of a block of texts (of about
    _BLOCK_TOKENS shingles, however small batches are): the shingles that at least half of the share of the block's classes have, with their counts."""

    def count(sets: dict[int, np.ndarray]) -> list | None:
        if not sets:
            return None
        tokens, counts = np.unique(np.concatenate(list(sets.values())), return_counts=True)
        often = counts >= max(least, share * len(sets) / 2)
        return [{"token": t, "n": c} for t, c in zip(tokens[often].view(np.int64).tolist(), counts[often].tolist(), strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}
        total, held = 0, None

        def made(held: tuple, common: list | None) -> pa.RecordBatch:
            ids, n, sig = held
            return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(sig, pa.int64()), pa.array([None] * (len(n) - 1) + [common], _COUNTS)], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            if held:
                full = total >= _BLOCK_TOKENS
                yield made(held, count(sets) if full else None)
                if full:
                    sets, total = {}, 0
            n, sig = [], []
            for x in shingle_sets(batch.column(1), k):
                n.append(len(x))
                sig.append(signature(x))
                if sig[-1] is not None and sig[-1] not in sets:
                    sets[sig[-1]] = x
                    total += len(x)
            held = (batch.column(0), n, sig)
        if held:
            yield made(held, count(sets))

    return run


def common_shingles(base: DataFrame, share: float) -> np.ndarray:
    """The shingles that half of the share of all classes have, by the counts of blocks. Which these are changes no result, only
    the way that shingles take."""
    classes = base.agg(F.approx_count_distinct("sig").alias("n")).first().n
    counted = base.where("common is not null").select(F.explode("common").alias("c")).groupBy("c.token").agg(F.sum("c.n").alias("n"))
    rows = counted.where(F.col("n") >= share * classes / 2).select("token").toArrow().column(0).to_numpy()
    return np.sort(rows.astype(np.int64).view(np.uint64))


def needed(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def _pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *(len(a) for a in arrays)], np.int64)
    return head.tobytes() + b"".join(a.tobytes() for a in arrays)


def _unpack(blob: bytes, *kinds: type) -> list[np.ndarray]:
    head = np.frombuffer(blob, np.int64, 1 + len(kinds))
    out, at = [], head.nbytes
    for n, kind in zip(head[1:], kinds, strict=True):
        a = np.frombuffer(blob, kind, int(n), at)
        out.append(a)
        at += a.nbytes
    return out


_MOST = (1 << 32) - 1


def _by_group(groups: int, name: np.ndarray, *others: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Columns dealt by the class: (group, packed)."""
    group = (name % groups).astype(np.int32)
    order = np.argsort(group, kind="stable")
    edges = np.flatnonzero(np.concatenate(([True], np.diff(group[order]) != 0, [True]))) if len(order) else np.zeros(1, np.int64)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield int(group[order[a]]), _pack(*(x[order[a:b]] for x in (name, *others)))


_BLOBS = pa.schema([("bucket", pa.int32()), ("blob", pa.binary())])


def _deal_shingles(k: int, buckets: int, common):
    """Texts to (bucket, packed: class ids, their set sizes, shingles, index of the shingle's class), and for common shingles to
    (buckets + class group, packed as _repeated does)."""

    def flush(sets: list[np.ndarray], ids: list[int]) -> Iterator[pa.RecordBatch]:
        if not sets:
            return
        sizes = np.array([len(s) for s in sets], np.uint32)
        tokens, of = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.uint16), sizes)
        heavy = common.value
        if len(heavy):
            is_heavy = heavy[np.minimum(np.searchsorted(heavy, tokens), len(heavy) - 1)] == tokens
            who = of[is_heavy]
            name = np.array(ids, np.int64)[who]
            for g, blob in _by_group(buckets, name, sizes[who], tokens[is_heavy], np.full(len(who), _MOST, np.uint32)):
                yield pa.RecordBatch.from_arrays([pa.array([buckets + g], pa.int32()), pa.array([blob], pa.binary())], schema=_BLOBS)
            tokens, of = tokens[~is_heavy], of[~is_heavy]
        bucket = ((tokens >> np.uint64(24)) % np.uint64(buckets)).astype(np.uint32)
        order = np.argsort(bucket, kind="stable")
        edges = np.flatnonzero(np.concatenate(([True], np.diff(bucket[order]) != 0, [True]))) if len(order) else np.zeros(1, np.int64)
        names = np.array(ids, np.int64)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            part = order[a:b]
            # a stable order keeps the classes of a bucket together
            mine = of[part]
            new = np.concatenate(([True], mine[1:] != mine[:-1]))
            used = mine[new]
            yield pa.RecordBatch.from_arrays([pa.array([int(bucket[part[0]])], pa.int32()), pa.array([_pack(names[used], sizes[used], tokens[part], (np.cumsum(new) - 1).astype(np.uint16))], pa.binary())], schema=_BLOBS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, ids, total, seen = [], [], 0, set()
        for batch in batches:
            for tokens in shingle_sets(batch.column(0), k):
                sig = signature(tokens)
                if sig is None or sig in seen:  # a class once in a while, however many copies follow
                    continue
                if len(seen) >= 200_000:
                    seen.clear()
                seen.add(sig)
                sets.append(tokens)
                ids.append(sig)
                total += len(tokens)
                if total >= _BLOCK_TOKENS or len(sets) == 65_535:
                    yield from flush(sets, ids)
                    sets, ids, total = [], [], 0
        yield from flush(sets, ids)

    return run


def _repeated(groups: int):
    """One bucket of shingles to (class group, packed: class, set size, shingle, frequency) of those in two classes or more."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        if int(key[0]) >= groups:  # common shingles on their way to their classes
            return pd.DataFrame({"bucket": int(key[0]) - groups, "blob": pdf["blob"]})
        names, sizes, tokens, of, base = [], [], [], [], 0
        for blob in pdf["blob"]:
            n, s, t, o = _unpack(blob, np.int64, np.uint32, np.uint64, np.uint16)
            names.append(n)
            sizes.append(s)
            tokens.append(t)
            of.append(o.astype(np.uint32) + np.uint32(base))
            base += len(n)
        names, sizes, tokens, of = (np.concatenate(x) for x in (names, sizes, tokens, of))
        order = np.argsort(tokens)
        t = tokens[order]
        same = t[1:] == t[:-1]
        more = np.zeros(len(t), bool)
        more[1:] |= same
        more[:-1] |= same
        t, row = t[more], of[order[more]]
        name = names[row]
        order = np.lexsort((name, t))
        t, row, name = t[order], row[order], name[order]
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1]) | (name[1:] != name[:-1])
        t, row, name = t[new], row[new], name[new]
        starts = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1]))) if len(t) else np.zeros(0, np.int64)
        freq = np.repeat(np.diff(np.concatenate((starts, [len(t)]))), np.diff(np.concatenate((starts, [len(t)])))) if len(t) else np.zeros(0, np.int64)
        ok = freq >= 2
        t, name, n, freq = t[ok], name[ok], sizes[row[ok]], np.minimum(freq[ok], _MOST - 1).astype(np.uint32)
        rows = list(_by_group(groups, name, n, t, freq))
        return pd.DataFrame(rows, columns=["bucket", "blob"])

    return run


def _survivors(percent: int):
    """One class group to the classes that can have a partner: sig, n, repeated shingles in order of (frequency, hash)."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [_unpack(b, np.int64, np.uint32, np.uint64, np.uint32) for b in pdf["blob"]]
        name, n, t, freq = (np.concatenate([p[i] for p in parts]) for i in range(4))
        order = np.lexsort((t, freq, name))
        name, n, t = name[order], n[order], t[order]
        # common shingles come from every task that saw a copy
        once = np.concatenate(([True], (name[1:] != name[:-1]) | (t[1:] != t[:-1])))
        name, n, t = name[once], n[once], t[once]
        starts = np.flatnonzero(np.concatenate(([True], name[1:] != name[:-1])))
        ends = np.concatenate((starts[1:], [len(name)]))
        rows = [(int(name[a]), int(n[a]), t[a:b].tobytes()) for a, b in zip(starts, ends, strict=True) if b - a >= needed(int(n[a]), percent)]
        return pd.DataFrame(rows, columns=["sig", "n", "tokens"])

    return run


def _prefixes(percent: int):
    """Classes to (shingle, class) of their short lists."""
    schema = pa.schema([("token", pa.int64()), ("sig", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, sigs = [], []
            for sig, n, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                every = np.frombuffer(blob, np.int64)
                short = every[: len(every) - needed(n, percent) + 1]
                tokens.append(short)
                sigs.append(np.full(len(short), sig, np.int64))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), pa.array(np.concatenate(sigs))], schema=schema)

    return run


class DivideSkip:
    """An inverted index over sets of shingles, for one block or chunk of one."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray, percent: int = PERCENT) -> None:
        self.percent, self.sizes = percent, [int(n) for n in sizes]
        tokens = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
        docs = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.lexsort((docs, tokens))
        self.vocabulary, starts = np.unique(tokens[order], return_index=True)
        # list i is docs[cut[i] : cut[i + 1]], ascending
        self.docs, self.cut = docs[order].tolist(), np.concatenate((starts, [len(tokens)]))

    def _merge(self, lists: list[tuple[int, int]], least: int) -> Iterator[tuple[int, int]]:
        """(document, occurrences) of those that stand in least or more of the lists (places in docs), by a heap of the lists' fronts.

        Where the smallest front doesn't occur often enough, least - 1 fronts are taken from the heap and their lists skip by binary
        search to the next smallest front: no document before it can be in least lists."""
        docs = self.docs
        heap = [(docs[at], at, end) for at, end in lists]
        heapq.heapify(heap)
        while len(heap) >= least:
            front = heap[0][0]
            taken = []
            while heap and heap[0][0] == front:
                taken.append(heapq.heappop(heap))
            if len(taken) >= least:
                yield front, len(taken)
                target = front + 1
            else:
                while heap and len(taken) < least - 1:
                    taken.append(heapq.heappop(heap))
                if not heap:
                    return
                target = max(front + 1, heap[0][0])
            for value, at, end in taken:
                if value < target:
                    at = bisect_left(docs, target, at + 1, end)
                if at < end:
                    heapq.heappush(heap, (docs[at], at, end))

    def search(self, tokens: np.ndarray, n: int, wanted: np.ndarray | None = None) -> list[int]:
        """The documents (of wanted, a mask) whose set links with a set of n shingles, of which tokens are the repeated ones."""
        at = np.searchsorted(self.vocabulary, tokens)
        at = at[(at < len(self.vocabulary)) & (self.vocabulary[np.minimum(at, len(self.vocabulary) - 1)] == tokens)] if len(self.vocabulary) else at[:0]
        threshold = needed(n, self.percent)
        if len(at) < threshold:
            return []
        lengths = self.cut[at + 1] - self.cut[at]
        at = at[np.argsort(lengths, kind="stable")]
        longest = max(2, int(lengths.max()))
        n_long = min(int(threshold / (_MU * math.log2(longest) + 1)), threshold - 1)
        lists = list(zip(self.cut[at].tolist(), self.cut[at + 1].tolist(), strict=True))
        short, long_ = lists[: len(at) - n_long], lists[len(at) - n_long :]
        docs, out = self.docs, []
        for d, count in self._merge(short, threshold - n_long):
            size = self.sizes[d]
            if wanted is not None and not wanted[d] or 100 * size < self.percent * n or 100 * n < self.percent * size:
                continue
            # (100 + p) * overlap >= p * (|A| + |B|) is the same as 100 * overlap >= p * |A or B|
            missing = -(-self.percent * (size + n) // (100 + self.percent)) - count
            left = len(long_)
            for a, b in long_:
                if missing <= 0 or missing > left:
                    break
                i = bisect_left(docs, d, a, b)
                missing -= i < b and docs[i] == d
                left -= 1
            if missing <= 0:
                out.append(d)
        return out


def _root(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return int(i)


def _search_block(percent: int):
    """The rows of one (block, chunk, query part) to links that join its families: role b is index and query, i and q one of them."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sig")
        roles = pdf["role"].to_numpy()
        sets = [np.frombuffer(b, np.uint64) for b in pdf["tokens"]]
        sizes, sigs = pdf["n"].to_numpy(np.int64), pdf["sig"].to_numpy(np.int64)
        inside = np.flatnonzero(roles != "q")
        index = DivideSkip([sets[i] for i in inside], sizes[inside], percent)
        # members of one family stand for each other from the start
        parent, first = np.arange(len(pdf)), {}
        for i, family in enumerate(pdf["family"].to_numpy(np.int64)):
            parent[i] = first.setdefault(family, i)
        same = {}
        for i, s in enumerate(sigs):  # a query that is in the index too
            j = same.setdefault(int(s), i)
            parent[_root(parent, i)] = _root(parent, j)
        roots = np.array([_root(parent, i) for i in range(len(pdf))])
        # of any two families one isn't the largest, so its classes alone need to ask; in a large block they are the queries already
        names, sizes_of = np.unique(roots[inside], return_counts=True)
        largest = names[sizes_of.argmax()] if len(names) else -1
        links = []
        for i in np.flatnonzero((roles == "q") | (roles == "b") & (roots != largest)):
            mine = _root(parent, i)
            wanted = roots[inside] != roots[i]
            if not wanted.any():
                continue
            for d in index.search(sets[i], int(sizes[i]), wanted):
                j = int(inside[d])
                other = _root(parent, j)
                if other != mine:
                    parent[other] = mine
                    links.append((int(sigs[i]), int(sigs[j])))
        return pd.DataFrame(links, columns=["a", "b"])

    return run


def _search_leaders(percent: int):
    """Rows of a class and one of its leaders, in order of leaders, to those that link, by an index of the leaders of some rows."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            for at in range(0, len(rows), CHUNK):
                part = rows[at : at + CHUNK]
                leaders: dict[int, int] = {}
                for row in part:
                    leaders.setdefault(row[3], len(leaders))
                first = {row[3]: row for row in reversed(part)}
                index = DivideSkip([np.frombuffer(first[s][5], np.uint64) for s in leaders], np.array([first[s][4] for s in leaders]), percent)
                a, b = [], []
                for sig, n, tokens, leader, _, _ in part:
                    wanted = np.zeros(len(leaders), bool)
                    wanted[leaders[leader]] = True
                    if index.search(np.frombuffer(tokens, np.uint64), n, wanted):
                        a.append(sig)
                        b.append(leader)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

    return run


def class_links(docs: DataFrame, text: str, common: np.ndarray, k: int, percent: int, chunk: int, shingles: int) -> DataFrame:
    """(a, b): links between classes that join every component of links."""
    spark = docs.sparkSession
    ship(spark)
    # a shingle takes 8 bytes and the index of its class; buckets grow with the input, not in size
    buckets = min(max(64, 10 * shingles // BUCKET_BYTES), 1 << 24)
    blob = "bucket int, blob binary"
    dealt = docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(_deal_shingles(k, buckets, spark.sparkContext.broadcast(common)), blob)
    back = dealt.groupBy("bucket").applyInPandas(_repeated(buckets), blob)
    classes = written(back.groupBy("bucket").applyInPandas(_survivors(percent), "sig bigint, n bigint, tokens binary"))
    short = classes.mapInArrow(_prefixes(percent), "token bigint, sig bigint")
    # written, so that the join has a plain exchange on either side and adaptive execution can split a hot shingle
    leaders = written(short.groupBy("token").agg(F.min("sig").alias("leader"), F.count("*").alias("n")).where("n > 1").select("token", "leader"))
    candidates = written(short.join(leaders, "token").where("sig <> leader").select("sig", "leader").distinct())
    blocks = written(connected_components(candidates).select(F.col("node").alias("sig"), F.col("root").alias("block")))
    sized = written(blocks.groupBy("block").agg(F.count("*").alias("size")))
    big = sized.where(F.col("size") > chunk)
    # the families of large blocks, by their leaders
    pairs = candidates.join(blocks.join(big, "block").select("sig"), "sig")
    sides = [classes.select(F.col("sig").alias(s), F.col("n").alias(f"n_{s}"), F.col("tokens").alias(f"t_{s}")) for s in ("x", "y")]
    both = pairs.join(sides[0], F.col("sig") == F.col("x")).join(sides[1], F.col("leader") == F.col("y"))
    by_leader = written(both.select("x", "n_x", "t_x", "y", "n_y", "t_y").mapInArrow(_search_leaders(percent), "a bigint, b bigint"))
    families = connected_components(by_leader).select(F.col("node").alias("sig"), F.col("root").alias("family"))
    members = blocks.join(sized, "block").join(families, "sig", "left").withColumn("family", F.coalesce("family", "sig"))
    members = written(members)
    per_family = members.where(F.col("size") > chunk).groupBy("block", "family").agg(F.count("*").alias("m"))
    main = per_family.groupBy("block").agg(F.max(F.struct("m", "family"))["family"].alias("main"), F.max("m").alias("main_size"))
    parts = F.ceil(F.col("size") / chunk).cast("int")
    query_parts = F.greatest(F.lit(1), F.ceil((F.col("size") - F.coalesce("main_size", F.lit(0))) / chunk)).cast("int")
    placed = members.join(main, "block", "left").withColumns({"chunks": parts, "q_parts": query_parts})
    deal = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "sig"), F.col(n)).cast("int")
    cells = placed.select(
        "sig", "block", "family",
        F.when(F.col("chunks") == 1, F.array(F.struct(F.lit("b").alias("role"), F.lit(0).alias("chunk"), F.lit(0).alias("part"))))
        .otherwise(
            F.concat(
                F.transform(F.sequence(F.lit(0), F.col("q_parts") - 1), lambda p: F.struct(F.lit("i").alias("role"), deal(1, "chunks").alias("chunk"), p.alias("part"))),
                F.when(F.col("family") != F.col("main"), F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.struct(F.lit("q").alias("role"), c.alias("chunk"), deal(2, "q_parts").alias("part")))).otherwise(F.array().cast("array<struct<role:string,chunk:int,part:int>>")),
            )
        ).alias("cells"),
    )
    rows = cells.select("sig", "block", "family", F.explode("cells").alias("c")).select("sig", "block", "family", "c.role", "c.chunk", "c.part").join(classes, "sig")
    found = rows.groupBy("block", "chunk", "part").applyInPandas(_search_block(percent), "a bigint, b bigint")
    links = written(by_leader.union(found))
    for table in (leaders, candidates, blocks, sized, members, classes):
        drop(table)
    return links


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K, percent: int = PERCENT, chunk: int = CHUNK, heavy: float = HEAVY, heavy_least: int = _HEAVY_LEAST) -> DataFrame:
    """(doc_id, n_shingles, component_id, sig, family): one row for each document; family is a name of the group, null without shingles."""
    source = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    ship(docs.sparkSession)
    kind = source.schema["doc_id"].dataType.simpleString()
    base = written(source.mapInArrow(_sizes_and_common(k, heavy, heavy_least, ["doc_id", "n_shingles", "sig", "common"]), f"doc_id {kind}, n_shingles bigint, sig bigint, common array<struct<token:bigint,n:bigint>>"))
    shingles = base.agg(F.sum("n_shingles").alias("n")).first().n or 0
    groups = connected_components(class_links(docs, text, common_shingles(base, heavy), k, percent, chunk, shingles))
    base = base.drop("common")
    classes = base.where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("low"))
    named = written(classes.join(groups.withColumnRenamed("node", "sig"), "sig", "left").select("sig", "low", F.coalesce("root", "sig").alias("family")))
    lowest = named.groupBy("family").agg(F.min("low").alias("component_id"))
    by_class = named.join(lowest, "family").select("sig", "family", "component_id")
    joined = base.join(by_class, "sig", "left")
    return joined.select("doc_id", "n_shingles", F.when(F.col("sig").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "sig", "family")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K, percent: int = PERCENT) -> DataFrame:
    """docs less all but one document of each group: the smallest id stays (of rows with that id one). Documents without shingles stay."""
    marked = components(docs, doc_id, text, k, percent)
    stay = marked.where("family is not null").groupBy("family").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sig")).alias("s"))
    names = [fresh("sig", docs.columns), fresh("n", docs.columns)]
    seen = scan_text(docs, text, f"`{names[1]}` bigint, `{names[0]}` bigint", _sizes(k))
    sig = F.col(f"`{names[0]}`")
    kept = seen.join(stay.select(F.col("s.doc_id").alias("\x01id"), F.col("s.sig").alias("\x01sig")), F.col(f"`{doc_id}`").eqNullSafe(F.col("\x01id")) & (sig == F.col("\x01sig")), "left_semi")
    return kept.dropDuplicates([doc_id, names[0]]).union(seen.where(sig.isNull())).select(*[F.col(f"`{c}`") for c in docs.columns])
