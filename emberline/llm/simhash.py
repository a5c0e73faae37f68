"""SimHash near-duplicates, linked through a Gray-order hierarchical index.

All distinct fingerprints are put in Gray order and cut into ranges. A node of the index keeps the bits that all its
codes share and that no ancestor keeps; the topmost levels are over the ranges, the others over one range's codes. A
search adds up the differing bits on its way down and drops a whole node, or a whole range, as soon as the sum exceeds
the limit; so each code is sent to the ranges alone that the upper levels leave. A node of which all codes are already
connected to the query is dropped too, so a large group of near copies costs no comparison of all its pairs. A range's
task holds the range's codes; queries stream through it. Links are given as edges to one code of the component.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce
from itertools import combinations, groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import cut, small_batches, stored
from emberline.llm.components import connected_components

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
LANES = np.uint64(0x0101010101010101)
FAN = 4
#: Pairs of a search step that are held at once, and queries between two looks at what is connected.
FRONT, STEP = 1 << 19, 1 << 13
#: Codes of a range, about, and ranges at least.
CODES, RANGES = 1 << 20, 32
#: Codes of a bucket: on average at most; up to which all buckets are compared at once; over which by an index; over which by ranges. Rows that a task holds.
BUCKET, FEW, MANY, HOT, HELD = 2048, 64, 8192, 1 << 16, 1 << 19
#: Bit number of bit k of byte lane j, at [k, j].
PLACES = (np.arange(8)[:, None] + 8 * np.arange(8)).astype(np.uint64)
#: Parts that the rows of one component are dealt into where they meet their component's row.
SALT = 16


def prints(text: bytes, words: int = 4, seed: int = 42, many: int = 1) -> np.ndarray:
    """SimHashes of the word shingles of UTF-8 text, no word: 0. The first is of their XXH64, each other one of these mixed anew."""
    w = text.translate(LOWER).split()
    if not w:
        return np.zeros(many, np.uint64)
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)))) if len(w) >= words else [b" ".join(w)]
    h = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=seed), shingles), np.uint64)
    if many > 1:
        h = np.stack([h, *(_mixed(h, i) for i in range(1, many))])
    h = h.reshape(many, -1)
    n = h.shape[1]
    if n == 1:
        return h[:, 0]
    counts = np.empty((many, 8, 8), np.int64)  # of bit k of byte lane j
    starts = np.arange(0, n, 255)
    for k in range(8):
        sums = np.add.reduceat((h >> np.uint64(k)) & LANES, starts, axis=1)  # lanes hold up to 255 each
        counts[:, k] = sums.view(np.uint8).reshape(many, -1, 8).sum(axis=1, dtype=np.int64)
    return ((2 * counts > n) * (np.uint64(1) << PLACES)).sum(axis=(1, 2), dtype=np.uint64)


def _mixed(h: np.ndarray, i: int) -> np.ndarray:
    h = h + np.uint64(i * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprint(text: bytes, words: int = 4, seed: int = 42) -> int:
    return int(prints(text, words, seed)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], words: int, seed: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = np.array([fingerprint(t or b"", words, seed) for t in b.column(1).cast(pa.binary()).to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])


def _prints(batches: Iterator[pa.RecordBatch], words: int, seed: int, many: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [prints(t or b"", words, seed, many).view(np.int64) for t in b.column(1).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.list_(pa.int64())), b.column(2)], ["doc_id", "fps", "row_hash"])


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the reflected Gray order."""
    x = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """Hierarchical index over masked uint64 patterns in Gray order; each level above has groups of FAN nodes.

    ``compared`` and ``dropped`` count, by level, the nodes that queries met and those among them that they dropped.
    """

    def __init__(self, value: np.ndarray, mask: np.ndarray | None = None):
        mask = np.full(len(value), ~np.uint64(0)) if mask is None else mask
        levels = [(value, mask)]
        while len(value) > FAN:
            at = np.arange(0, len(value), FAN)
            ones, zeros = np.bitwise_and.reduceat(value & mask, at), np.bitwise_and.reduceat(~value & mask, at)
            value, mask = ones, ones | zeros
            levels.append((value, mask))
        self.value = [v for v, _ in levels]
        #: A node's own bits: those that its parent doesn't keep.
        self.own = [m & ~np.repeat(levels[i + 1][1], FAN)[: len(m)] if i + 1 < len(levels) else m for i, (_, m) in enumerate(levels)]
        self.compared, self.dropped = (np.zeros(len(levels), np.int64) for _ in range(2))

    def marks(self, label: np.ndarray) -> list[np.ndarray]:
        """By level: the label that all of a node's codes have, or -1."""
        out = [label]
        for v in self.value[1:]:
            at = np.arange(0, len(out[-1]), FAN)
            low, high = np.minimum.reduceat(out[-1], at), np.maximum.reduceat(out[-1], at)
            out.append(np.where(low == high, low, -1))
        return out

    def likely(self, queries: np.ndarray) -> np.ndarray:
        """For each query the code that one way down finds, by the nearest node of each level."""
        at, far = np.zeros(len(queries), np.int64), np.zeros((len(queries), 1), np.int64)
        for level in range(len(self.value) - 1, -1, -1):
            n = len(self.value[level])
            kids = np.minimum(at[:, None] * FAN + np.arange(FAN if level < len(self.value) - 1 else n), n - 1)
            d = far + np.bitwise_count((queries[:, None] ^ self.value[level][kids]) & self.own[level][kids])
            best = d.argmin(axis=1)[:, None]
            at, far = np.take_along_axis(kids, best, 1)[:, 0], np.take_along_axis(d, best, 1)
        return at

    def search(self, queries: np.ndarray, distance: int, known: tuple[list[np.ndarray], np.ndarray] | None = None, after: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Yields (query number, code number) of all pairs at up to ``distance`` differing bits.

        ``known``: nodes' marks and each query's label (-1: none); pairs with equal labels are left out. ``after``:
        for each query a code number; pairs with codes up to it are left out.
        """
        top = len(self.value) - 1
        if not len(self.value[top]):
            return
        step = max(1, FRONT // len(self.value[top]))
        for begin in range(0, len(queries), step):
            q = np.arange(begin, min(len(queries), begin + step))
            stack = [(top, np.repeat(q, len(self.value[top])), np.tile(np.arange(len(self.value[top])), len(q)), np.int16(0))]
            while stack:
                level, q, node, far = stack.pop()
                d = np.bitwise_count((queries[q] ^ self.value[level][node]) & self.own[level][node]).astype(np.int16) + far
                near = d <= distance
                self.compared[level] += len(q)
                self.dropped[level] += len(q) - int(near.sum())
                if known is not None:
                    near &= (known[0][level][node] != known[1][q]) | (known[1][q] < 0)
                if after is not None:
                    near &= (node + 1) * FAN**level - 1 > after[q]
                q, node, d = q[near], node[near], d[near]
                if not level:
                    if len(q):
                        yield q, node
                    continue
                for k in range(0, len(q), FRONT // FAN):
                    kids = (node[k : k + FRONT // FAN, None] * FAN + np.arange(FAN)).ravel()
                    there = kids < len(self.value[level - 1])
                    stack.append((level - 1, np.repeat(q[k : k + FRONT // FAN], FAN)[there], kids[there], np.repeat(d[k : k + FRONT // FAN], FAN)[there]))


class RangeLinks:
    """The index of one range's distinct codes, and which of them are connected so far."""

    def __init__(self, codes: np.ndarray, distance: int):
        self.rank = np.sort(gray_rank(codes))
        self.codes = self.rank ^ (self.rank >> np.uint64(1))
        self.index, self.distance = GrayIndex(self.codes), distance
        self.root = np.arange(len(codes))
        at = np.arange(len(codes))
        self._search(self.codes, at, at)

    def _top(self, x: np.ndarray) -> np.ndarray:
        while True:
            y = self.root[x]
            if (y == x).all():
                return x
            x = y

    def _union(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self._top(a), self._top(b)
            differ = ra != rb
            a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
            np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))

    def _met(self, label: np.ndarray, q: np.ndarray, c: np.ndarray) -> None:
        new = label[q] < 0
        label[q[new]] = c[new]
        self._union(label[q], c)

    def _search(self, queries: np.ndarray, label: np.ndarray, after: np.ndarray | None) -> None:
        """Connects queries, by their codes' numbers in ``label`` (-1: none yet), with the codes near them."""
        last = len(self.codes) - 1
        place = np.searchsorted(self.rank, gray_rank(queries))
        for beside in (np.minimum(place, last), np.maximum(place - 1, 0), self.index.likely(queries)):  # one near code leaves out all that are connected to it
            q = np.flatnonzero(np.bitwise_count(queries ^ self.codes[beside]) <= self.distance)
            self._met(label, q, beside[q])
        at, step = 0, 64
        while at < len(queries):
            part = slice(at, at + step)
            self.root = self._top(self.root)
            own = np.where(label[part] < 0, -1, self.root[np.maximum(label[part], 0)])
            for q, c in self.index.search(queries[part], self.distance, (self.index.marks(self.root), own), None if after is None else after[part]):
                self._met(label, q + at, c)
            at, step = at + step, min(2 * step, STEP)

    def link(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges from queries of other ranges."""
        label = np.full(len(queries), -1)
        self._search(queries, label, None)
        linked = label >= 0
        return queries[linked], self.codes[self._top(label[linked])]

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        root = self._top(self.root)
        linked = root != np.arange(len(root))
        return self.codes[linked], self.codes[root[linked]]


class Ranges:
    """The upper levels: the ranges' ends in Gray order and the bits that each one's codes share."""

    def __init__(self, ends: np.ndarray):
        self.ends, self.index, self.number = ends, None, None

    def of(self, codes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, gray_rank(codes))

    def know(self, number: np.ndarray, ones: np.ndarray, zeros: np.ndarray) -> None:
        """Numbers of the ranges that have codes, in order, and their shared bits."""
        self.number, self.index = number, GrayIndex(ones, ones | zeros)

    def sent(self, codes: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(range, code number) of where codes are asked for. Of two ranges one asks the other, so that all have about as much to do."""
        own = self.of(codes)
        for q, node in self.index.search(codes, distance):
            there = self.number[node]
            asks = np.where((there + own[q]) % 2 == 0, there > own[q], there < own[q])
            yield there[asks], q[asks]


def _uint(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).view(np.uint64)


def _shared_bits(batches: Iterator[pa.RecordBatch], ranges: Ranges) -> Iterator[pa.RecordBatch]:
    """(fp) -> (range, ones, zeros): bits that a batch's codes of a range share."""
    for b in batches:
        codes = np.sort(gray_rank(_uint(b.column(0))))
        at, first = np.unique(np.searchsorted(ranges.ends, codes), return_index=True)
        codes ^= codes >> np.uint64(1)
        if len(first):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (at, np.bitwise_and.reduceat(codes, first).view(np.int64), np.bitwise_and.reduceat(~codes, first).view(np.int64))], ["range", "ones", "zeros"])


def _sent(batches: Iterator[pa.RecordBatch], ranges: Ranges, distance: int) -> Iterator[pa.RecordBatch]:
    """(fp) -> (range, asks, fp): each code in its own range, and as a query where it is asked for."""
    for b in batches:
        codes = _uint(b.column(0))
        for asks, (there, at) in ((False, (ranges.of(codes), slice(None))), *((True, x) for x in ranges.sent(codes, distance))):
            yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(np.full(len(there), asks)), pa.array(codes[at].view(np.int64))], ["range", "asks", "fp"])


def _links(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Rows of :func:`_sent` in order, whole ranges -> edges (u, v)."""

    def edges(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (u, v)], ["u", "v"])

    for runs in _ranges(batches):
        held, links, waiting = [], None, []
        for asks, codes in runs:
            if not asks:
                held.append(codes)
                continue
            links = links or RangeLinks(np.concatenate(held), distance)
            waiting.append(codes)
            if sum(map(len, waiting)) >= 8 * STEP:
                yield edges(*links.link(np.concatenate(waiting)))
                waiting = []
        links = links or RangeLinks(np.concatenate(held), distance)
        if waiting:
            yield edges(*links.link(np.concatenate(waiting)))
        yield edges(*links.edges())


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[Iterator[tuple[bool, np.ndarray]]]:
    """Of each range the runs (asks, codes), in order."""

    def runs() -> Iterator[tuple[int, bool, np.ndarray]]:
        for b in batches:
            r, asks, codes = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False), _uint(b.column(2))
            at = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (asks[1:] != asks[:-1])]) if len(r) else ()
            for i, j in zip(at, [*at[1:], len(r)]):
                yield int(r[i]), bool(asks[i]), codes[i:j]

    for _, group in groupby(runs(), key=lambda x: x[0]):
        yield (x[1:] for x in group)


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42) -> DataFrame:
    """Rows ``(doc_id, fp)``; a null text counts as empty."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(partial(_fingerprints, words=words, seed=seed), "doc_id long, fp long")


def row_hash(docs: DataFrame) -> Column:
    """A hash of all columns of a row; a null counts, as its place does."""
    return F.xxhash64(*docs.columns, *(F.col(c).isNull() for c in docs.columns))


def _rank(fp: Column) -> Column:
    """As :func:`gray_rank`, in the order of signed numbers."""
    for n in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, n))
    return fp.bitwiseXOR(F.lit(-(1 << 63)))


def code_links(codes: DataFrame, distance: int = 4, size: int = CODES, least: int = RANGES) -> DataFrame:
    """Edges ``(u, v)`` that connect all distinct codes ``fp`` at up to ``distance`` differing bits, and no others.

    ``codes`` is read three times. There is a range for each ``size`` codes, ``least`` of them at least; one row of
    each comes to the driver and goes to the tasks (at 10**10 codes 10,000 rows of 32 bytes).
    """
    parts = max(least, -(-codes.count() // size))
    ends = codes.agg(F.percentile_approx(_rank(F.col("fp")), [i / parts for i in range(1, parts)], 10 * parts)).first()[0] if parts > 1 else None
    ranges = Ranges(np.unique(np.array(ends or [], np.int64)).view(np.uint64) ^ np.uint64(1 << 63))
    shared = codes.select("fp").mapInArrow(partial(_shared_bits, ranges=ranges), "range long, ones long, zeros long")
    found = shared.groupBy("range").agg(F.bit_and("ones").alias("ones"), F.bit_and("zeros").alias("zeros")).orderBy("range").collect()
    ranges.know(*(np.array([r[c] for r in found], np.int64).view(kind) for c, kind in (("range", np.int64), ("ones", np.uint64), ("zeros", np.uint64))))
    sent = codes.select("fp").mapInArrow(partial(_sent, ranges=ranges, distance=distance), "range long, asks boolean, fp long")
    return sent.repartition(parts, "range").sortWithinPartitions("range", "asks").mapInArrow(partial(_links, distance=distance), "u long, v long")


def agreements(n: int, distance: int) -> list[np.uint64]:
    """Masks of which at least one leaves equal codes of any two that differ in up to ``distance`` bits.

    The 64 bits are cut into blocks; such codes agree on all but ``distance`` of them. There are so many blocks that
    about BUCKET of ``n`` codes at most agree on a mask.
    """
    blocks = distance + 1
    while n >> (64 * (blocks - distance) // blocks) > BUCKET and blocks < 16:
        blocks += 1
    ends = [64 * i // blocks for i in range(blocks + 1)]
    masks = [sum(1 << b for b in range(i, j)) for i, j in zip(ends, ends[1:])]
    return [np.uint64(sum(some)) for some in combinations(masks, blocks - distance)]


def _keyed(batches: Iterator[pa.RecordBatch], masks: list[np.uint64]) -> Iterator[pa.RecordBatch]:
    """(fp) -> (key, fp) for each mask; equal masked codes have equal keys."""
    for b in batches:
        codes = _uint(b.column(0))
        for i, mask in enumerate(masks):
            yield pa.RecordBatch.from_arrays([pa.array(_mixed(codes & mask, i + 1).view(np.int64)), b.column(0)], ["key", "fp"])


def _near(codes: np.ndarray, first: np.ndarray, size: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of codes, by number, of the same bucket at up to ``distance`` differing bits."""
    few = size <= FEW
    starts, left = first[few], size[few]
    at = np.repeat(starts - (np.cumsum(left) - left), left) + np.arange(left.sum())
    end = np.repeat(starts + left, left)
    for step in range(1, FEW):
        there = at + step < end
        at, end = at[there], end[there]
        if not len(at):
            break
        near = np.bitwise_count(codes[at] ^ codes[at + step]) <= distance
        yield at[near], at[near] + step
    for i, n in zip(first[~few], size[~few]):
        own = codes[i : i + n]
        if n > MANY:
            links, found = RangeLinks(own, distance), np.argsort(gray_rank(own))
            yield i + found, i + found[links._top(links.root)]
            continue
        for j in range(0, n, 256):
            a, b = np.nonzero(np.bitwise_count(own[j : j + 256, None] ^ own[None, j:]) <= distance)
            apart = a < b
            yield i + j + a[apart], i + j + b[apart]


def _bucket_links(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp) in the order of key -> edges (u, v); a code of a bucket of over HOT codes gets one without ``v``."""

    def edges(keys: np.ndarray, codes: np.ndarray) -> Iterator[pa.RecordBatch]:
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        size = np.diff(np.r_[first, len(keys)])
        hot = size > HOT
        root = np.arange(len(codes))
        for a, b in _near(codes, first[~hot], size[~hot], distance):
            root = _united(root, a, b)
        root = _top(root, np.arange(len(root)))
        linked = np.flatnonzero(root != np.arange(len(root)))
        yield pa.RecordBatch.from_arrays([pa.array(codes[x].view(np.int64)) for x in (linked, root[linked])], ["u", "v"])
        for i, n in zip(first[hot], size[hot]):
            yield pa.RecordBatch.from_arrays([pa.array(codes[i : i + n].view(np.int64)), pa.nulls(n, pa.int64())], ["u", "v"])

    keys, codes = [], []
    for b in batches:
        if not b.num_rows:
            continue
        k, c = b.column(0).to_numpy(), _uint(b.column(1))
        cut_at = int(np.searchsorted(k, k[-1]))  # the last bucket may go on
        if keys and (cut_at or k[0] != keys[-1][-1]) and sum(map(len, keys)) >= HELD:
            yield from edges(np.concatenate([*keys, k[:cut_at]]), np.concatenate([*codes, c[:cut_at]]))
            keys, codes, k, c = [], [], k[cut_at:], c[cut_at:]
        keys.append(k)
        codes.append(c)
    if keys:
        yield from edges(np.concatenate(keys), np.concatenate(codes))


def _top(root: np.ndarray, x: np.ndarray) -> np.ndarray:
    while True:
        y = root[x]
        if (y == x).all():
            return x
        x = y


def _united(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    while len(a):
        ra, rb = _top(root, a), _top(root, b)
        differ = ra != rb
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
    return root


def block_links(codes: DataFrame, distance: int = 4) -> DataFrame:
    """Edges as of :func:`code_links`, which they connect alike, found among codes that agree on blocks of bits.

    A code goes to one bucket for each of :func:`agreements`, so the comparisons hardly grow faster than the codes,
    whereas in ranges each code is sought in about half of them. Codes of buckets of over HOT codes go to ranges.
    """
    n = codes.count()
    masks = agreements(n, distance)
    sent = codes.select("fp").mapInArrow(partial(_keyed, masks=masks), "key long, fp long")
    sent = sent.repartition(max(RANGES, -(-n * len(masks) // CODES)), "key").sortWithinPartitions("key")
    found = cut(sent.mapInArrow(partial(_bucket_links, distance=distance), "u long, v long"))
    links, hot = found.where("v is not null"), found.where("v is null")
    return links if hot.isEmpty() else links.unionByName(code_links(cut(hot.select(F.col("u").alias("fp")).distinct()), distance))


def _rooted(nodes: DataFrame, distance: int) -> DataFrame:
    """Rows with distinct ``fp`` -> also ``root``, one code of the component."""
    roots = connected_components(code_links(nodes.select("fp"), distance))
    return nodes.join(roots, nodes["fp"] == roots["node"], "left").withColumn("root", F.coalesce("root", "fp")).drop("node")


def representatives(docs: DataFrame, words: int = 5, distance: int = 4, seed: int = 42, many: int = 8) -> DataFrame:
    """The row that stands for each component of near-duplicates: ``doc_id, row_hash`` of it, and ``times`` it is there.

    Texts are linked if any of ``many`` independent fingerprints of them are at up to ``distance`` differing bits: one
    alone at 4 bits links few of the texts that are alike at 0.8 to 0.95, several link most. It is the row of the least
    doc_id, null last, and of the least :func:`row_hash` among rows of that doc_id. Null texts count as empty; empty
    texts are alike. Each fingerprint's links are written out before the next one's are sought, so that no plan grows
    with their number. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), row_hash(docs).alias("row_hash"))
    fps = cut(rows.mapInArrow(partial(_prints, words=words, seed=seed, many=many), "doc_id long, fps array<long>, row_hash long"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_hash", "times")).alias("least")
    nodes = cut(fps.groupBy("fps", "doc_id", "row_hash").agg(F.count("*").alias("times")).groupBy("fps").agg(least))
    nodes = cut(nodes.withColumn("id", F.monotonically_increasing_id()))
    parts = []
    for i in range(many):
        by_code = cut(nodes.groupBy(F.get("fps", F.lit(i)).alias("fp")).agg(F.min("id").alias("id")))
        ends = {x: by_code.withColumnsRenamed({"fp": code, "id": x}).hint("merge") for code, x in (("u", "a"), ("v", "b"))}
        linked = block_links(by_code.select("fp"), distance).join(ends["a"], "u").join(ends["b"], "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
        same = nodes.select(F.get("fps", F.lit(i)).alias("fp"), F.col("id").alias("u")).join(by_code.hint("merge"), "fp").where("u != id").select("u", F.col("id").alias("v"))
        parts.append(stored(linked.unionByName(same)))
    roots = connected_components(reduce(DataFrame.unionByName, (p for p, _ in parts)))
    for _, drop in parts:
        drop()
    rooted = nodes.join(roots, nodes["id"] == roots["node"], "left").select("least", F.coalesce("root", "id").alias("root"))
    return rooted.groupBy("root").agg(F.min("least").alias("least")).select("least.doc_id", "least.row_hash", "least.times")


def near_duplicates(docs: DataFrame, words: int = 4, distance: int = 4, seed: int = 42) -> DataFrame:
    """One row per document: ``doc_id, fingerprint (16 hex digits), component_id``.

    Null and empty texts, and texts of white space alone, have fingerprint zero and are linked like any other. Equal
    fingerprints always share a component; its id is the least doc_id in it (null if it has none). Repeated rows stay
    repeated; other columns are ignored. Of a text all shingles count, however many; a worker holds one text's at a
    time. An empty table gives an empty result.
    """
    fps = cut(fingerprints(docs, words, seed))
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    linked = cut(_rooted(nodes, distance)).withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALT)).cast("int"))
    many = linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")).where("n > 1")
    many = many.select("root", "component_id", "n", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))  # so that a large component is dealt out
    ids = linked.join(many, ["root", "salt"], "left").select("fp", F.when(F.col("n").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    return fps.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
