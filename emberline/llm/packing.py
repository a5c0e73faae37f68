"""Best-fit packing of token sequences with linear grouping.

Lengths are whole numbers up to the capacity, so the plan is made on their histogram: at most ``capacity`` rows,
whatever the number of documents. Large lengths are put in groups of equal cardinality and rounded up to the largest
of the group; column generation finds the configurations of those few sizes; whole multiples of each configuration
are filled with the actual lengths of the groups, and all that is left goes, longest first, where it fits best.
A piece finds its place by its rank among the pieces of its length.
"""

from __future__ import annotations

import base64
import bisect
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm.common import cut, small_batches

#: Numbers of groups that are tried for the large lengths.
GROUPS = (4, 8, 16, 32, 64)
#: Lengths over this share of the capacity are large.
LARGE = 1 / 3


# -- tokens ----------------------------------------------------------------------------------------------------------


@lru_cache(maxsize=2)
def encoder(path: str, ranks_path: str | None):
    """Text -> ids of the vocabulary at ``path``, as its ``encode(text, add_special_tokens=False)`` gives them.

    Where the vocabulary's ranks are given, a faster library does texts of common characters without the name of a
    special token; tests hold both against each other over whole tables.
    """
    from tokenizers import Tokenizer

    vocabulary = Tokenizer.from_file(path)
    plain = lambda text: vocabulary.encode_batch_fast([text], add_special_tokens=False)[0].ids  # noqa: E731, without the offsets of tokens
    if ranks_path is None:
        return plain
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    special = [t.content for t in vocabulary.get_added_tokens_decoder().values()]
    unsure = re.compile("|".join(["[^\t\n\r\x20-\x7e\xa1-\u024f\u2010-\u2027]", *map(re.escape, special)]))  # or where character tables might differ
    return lambda text: plain(text) if unsure.search(text) else fast(text)


def default_paths() -> tuple[str, str | None]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def piece_bounds(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first may be shorter than the capacity."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return [(0, first)] * (first > 0) + [(s, capacity) for s in range(first, n, capacity)]


def _pieces(batches: Iterator[pa.RecordBatch], paths: tuple[str, str | None], capacity: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    encode, part, seen = encoder(*paths), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
    for b in batches:
        out = []
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            ids = np.array([*(encode(text) if text else ()), 0], "<u4")
            for k, (start, n) in enumerate(piece_bounds(len(ids), capacity)):
                own = ids[start : start + n]
                out.append((doc, k, start, n, zlib.crc32(own.tobytes()), part, int(seen[n]), own.astype(np.int32) if with_ids else None))
                seen[n] += 1
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32()))
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank", "ids"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 8, kinds)], names)


# -- the plan --------------------------------------------------------------------------------------------------------


def equal_groups(sizes: list[tuple[int, int]], groups: int) -> list[list[tuple[int, int]]]:
    """(length, count) by falling length -> groups of equal cardinality; a length may be split between two."""
    total = sum(c for _, c in sizes)
    out: list[list[tuple[int, int]]] = []
    quota, free = -(-total // groups) if total else 0, 0
    for length, c in sizes:
        while c:
            if not free:
                out.append([])
                free = quota
            n = min(c, free)
            out[-1].append((length, n))
            c, free = c - n, free - n
    return out


def best_configuration(sizes: list[int], value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of sizes that fits in the capacity and has most value (knapsack by dynamic programming)."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        best[room], took[room] = best[room - 1], -1
        for i, s in enumerate(sizes):
            if s <= room and best[room - s] + value[i] > best[room] + 1e-12:
                best[room], took[room] = best[room - s] + value[i], i
    count, room = np.zeros(len(sizes)), capacity
    while room > 0:
        if took[room] < 0:
            room -= 1
        else:
            count[took[room]] += 1
            room -= sizes[took[room]]
    return float(best[capacity]), count


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 400) -> list[tuple[np.ndarray, float]]:
    """Configurations and their (fractional) numbers that cover the demand with least sequences, by column generation."""
    n = len(sizes)
    basis = np.diag([float(capacity // s) for s in sizes])  # columns: configurations
    need = np.array(demand, float)
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        number, dual = inverse @ need, inverse.sum(axis=0)
        value, column = best_configuration(sizes, dual, capacity)
        if value <= 1 + 1e-7:
            break
        step = inverse @ column
        ratio = np.where(step > 1e-9, np.maximum(number, 0) / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(np.argmin(ratio))] = column
    number = np.linalg.solve(basis, need)
    return [(basis[:, j].astype(int), float(number[j])) for j in range(n) if number[j] > 0]


class Plan:
    """Placements: the pieces of a length with ranks [rank, rank + n) go to sequences [first, first + n) at an offset."""

    def __init__(self, capacity: int):
        self.capacity, self.sequences = capacity, 0
        self.taken = np.zeros(capacity + 1, np.int64)
        self.rows: list[tuple[int, int, int, int, int]] = []  # length, rank, n, first, offset
        self.rooms: list[int] = []  # sorted, of blocks with room
        self.blocks: dict[int, list[tuple[int, int]]] = {}  # room -> (first, n)

    def place(self, length: int, first: int, n: int, used: int) -> None:
        self.rows.append((length, int(self.taken[length]), n, first, used))
        self.taken[length] += n

    def free(self, first: int, n: int, used: int) -> None:
        room = self.capacity - used
        if n and room:
            if room not in self.blocks:
                bisect.insort(self.rooms, room)
                self.blocks[room] = []
            self.blocks[room].append((first, n))

    def fill(self, slots: list[list[tuple[int, int]]], n: int) -> None:
        """n new sequences; each slot is a list of (length, count), n in all."""
        blocks = [(self.sequences, n, 0)]
        self.sequences += n
        for runs in slots:
            now, runs = [], [list(r) for r in runs]
            for first, size, used in blocks:
                while size:
                    m = min(size, runs[0][1])
                    self.place(runs[0][0], first, m, used)
                    now.append((first, m, used + runs[0][0]))
                    first, size = first + m, size - m
                    runs[0][1] -= m
                    if not runs[0][1]:
                        runs.pop(0)
            blocks = now
        for b in blocks:
            self.free(*b)

    def best_fit(self, length: int, count: int) -> None:
        while count:
            at = bisect.bisect_left(self.rooms, length)
            if at == len(self.rooms):
                many = self.capacity // length
                for n, each in ((count // many, many), (1, count % many)):
                    if n and each:
                        self.fill([[(length, n)]] * each, n)
                return
            room = self.rooms[at]
            first, n = self.blocks[room].pop()
            if not self.blocks[room]:
                del self.blocks[room], self.rooms[at]
            m = min(n, count)
            used = self.capacity - room
            self.place(length, first, m, used)
            self.free(first + m, n - m, used)
            self.free(first, m, used + length)
            count -= m


def plan(histogram: dict[int, int], capacity: int, groups: int = GROUPS[-1], large: float = LARGE) -> Plan:
    p = Plan(capacity)
    sizes = sorted(((x, c) for x, c in histogram.items() if c), reverse=True)
    left = dict(sizes)
    for x, c in sizes:
        if x == capacity:
            p.fill([[(x, c)]], c)
            left[x] = 0
    grouped = equal_groups([(x, c) for x, c in sizes if large * capacity < x < capacity], groups)
    if grouped:
        rounded = [g[0][0] for g in grouped]
        solved = configurations(rounded, [sum(c for _, c in g) for g in grouped], capacity)
        for config, number in sorted(solved, key=lambda s: -float(s[0] @ np.array(rounded))):
            # the actual lengths that stand for the rounded ones; demand isn't exceeded
            number = min([int(number + 1e-6), *(sum(c for _, c in g) // k for g, k in zip(grouped, config) if k)])
            if not number:
                continue
            slots = []
            for g, k in zip(grouped, config):
                for _ in range(k):
                    runs, need = [], number
                    while need:
                        x, c = g[0]
                        n = min(c, need)
                        runs.append((x, n))
                        left[x] -= n
                        need -= n
                        g[0] = (x, c - n)
                        if c == n:
                            g.pop(0)
                    slots.append(runs)
            p.fill(slots, number)
    for x in sorted(left, reverse=True):
        if left[x]:
            p.best_fit(x, left[x])
    return p


def least_plan(histogram: dict[int, int], capacity: int) -> Plan:
    """The plan of fewest sequences among those of GROUPS, of fewest groups on a tie. None goes below the tokens over the capacity."""
    least = -(-sum(x * c for x, c in histogram.items()) // capacity)
    best = None
    for groups in GROUPS:
        p = plan(histogram, capacity, groups)
        if best is None or p.sequences < best.sequences:
            best = p
        if best.sequences <= least:
            break
    return best


def _placed(batches: Iterator[pa.RecordBatch], rows: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Adds sequence_id and offset; rows: the plan's, sorted by length and rank."""
    key = rows[:, 0] << 44 | rows[:, 1]
    for b in batches:
        length, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
        i = np.searchsorted(key, length << 44 | rank, side="right") - 1
        names = [c for c in b.schema.names if c not in ("part", "rank", "before")]
        arrays = [b.column(b.schema.get_field_index(c)) for c in names]
        yield pa.RecordBatch.from_arrays([*arrays, pa.array(rows[i, 3] + rank - rows[i, 1]), pa.array(rows[i, 4])], [*names, "sequence_id", "offset"])


def pack(docs: DataFrame, capacity: int = 2048, paths: tuple[str, str | None] | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids`` on request).

    A document is its token ids and the id 0, so a null or empty text is one token. The name of a special token in a
    text is that token, as the vocabulary has it. Documents over the capacity, however long, are cut; others stay
    whole. Rows with one doc_id, a null one too, are documents of their own; of pieces of equal length, which goes
    where depends on the order read. Other columns are ignored. An empty table gives an empty result. The driver sees
    the histogram of lengths alone, at most ``capacity`` rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long, ids array<int>"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(partial(_pieces, paths=paths or default_paths(), capacity=capacity, with_ids=with_ids), schema)
    rows = cut(rows if with_ids else rows.drop("ids"))
    counts = rows.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = counts.select("part", "length", F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    placements = np.array(sorted(least_plan(histogram, capacity).rows), np.int64).reshape(-1, 5)
    ranked = rows.join(before, ["part", "length"]).withColumn("rank", F.col("rank") + F.coalesce("before", F.lit(0)))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else []), "rank")
    out = "doc_id long, piece int, start long, length long, ids_crc32 long, " + "ids array<int>, " * with_ids + "sequence_id long, offset long"
    return ranked.mapInArrow(partial(_placed, rows=placements), out)
