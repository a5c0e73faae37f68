"""Exact repeats of long byte strings: a column-wise construction over aligned passages of all documents.

Which bytes are covered by a string of ``length`` bytes that also starts elsewhere is found in three steps.

1. Anchors. Of every run of ``length - GRAM + 1`` neighbouring grams the one with the least hash is an anchor. Two
   equal strings of ``length`` bytes hold the same grams, so they hold the same anchor at the same place.
2. Passages. Each anchor that starts more than once gives its passage: all bytes that any string around it can have.
   Passages of one anchor are aligned at it.
3. Columns. All passages of a task form a collection. Each round inserts one symbol in front of every passage, from
   the last column to the first: the order of the passages by what follows (the column of the collection's
   Burrows-Wheeler transform) is updated by a stable distribution on the new symbol, and the common prefixes of
   neighbours by range minima. A string repeats where a neighbour shares ``length`` symbols. The rounds read a
   sequential column-major array in which a column is one contiguous slice.

Passages that are equal are combined in each task before they move, with a list of their owners. Around an anchor of
very many texts the passages are dealt by where strings start, in the end into one part for each start: then strings
move as digests, and a task has one row for each string of another task at most.

Equal whole texts are treated once, and are covered as a whole. A text is known by 120 bits of its SHA-256.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import cut, small_batches, stored, text_or_empty

GRAM = 32
#: Texts that share an anchor beyond which its passages are grouped by longer cores, and the parts of the starts then;
#: with 0 parts each start is one.
LEVELS = ((20_000, 2), (200_000, 0))
#: Distinct passages, and owners, that a task combines before it sends them.
COMBINED, OWNERS = 20_000, 200_000
#: Symbol of a column outside the document; it equals no byte.
OUTSIDE = 256
PLACE = np.uint64((1 << 24) - 1)
#: Bytes of a document that are hashed at once.
CHUNK = 1 << 21
#: Passages that one task puts in order.
PASSAGES = 25_000
ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each gram of GRAM bytes, by doubling."""
    h = (data.astype(np.uint64) + np.uint64(1)) * ODD
    n, base = 1, np.array([0xD6E8FEB86659FD93], np.uint64)
    while n < GRAM:
        h = h[:-n] * base + h[n:]
        base = base * base
        n *= 2
    return _mix(h)


def window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least value of each w neighbours, by doubling."""
    n = 1
    while n * 2 <= w:
        x = np.minimum(x[:-n], x[n:])
        n *= 2
    return np.minimum(x[: len(x) - (w - n)], x[w - n :]) if w > n else x


def anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of one text: the last of the least grams of every window."""
    w = length - GRAM + 1
    places, hashes = [], []
    for at in range(0, max(0, len(data) - length + 1), CHUNK):
        part = data[at : at + CHUNK + length - 1]
        h = gram_hashes(part)
        back = np.arange(len(h) - 1, -1, -1, dtype=np.uint64)
        least = window_min((h & ~PLACE) | back, w)
        i = np.unique(len(h) - 1 - (least & PLACE).astype(np.int64))
        places.append(i + at), hashes.append(h[i])
    if not places:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    p, first = np.unique(np.concatenate(places), return_index=True)
    return p, np.concatenate(hashes)[first]


def _anchor_rows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(key, key2, text), each text not yet seen in this task -> (anchor, key, key2, place, more): one row per distinct anchor of a text, with all its places."""
    seen: set[tuple[int, int]] = set()
    for b in batches:
        keys, anchor, place, more = [], [], [], []
        for *k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist()):
            if tuple(k) in seen or len(text) < length:
                continue
            if len(seen) < 1 << 20:  # what isn't known any more is only sent twice
                seen.add(tuple(k))
            p, h = anchors(np.frombuffer(text, np.uint8), length)
            own, first, n = np.unique(h.view(np.int64), return_index=True, return_counts=True)
            keys.append(np.tile(k, (len(own), 1))), anchor.append(own), place.append(p[first])
            rest: list = [None] * len(own)
            if len(own) < len(h):
                order = np.argsort(h.view(np.int64), kind="stable")
                ends = np.cumsum(n)
                for i in np.flatnonzero(n > 1):
                    rest[i] = p[order[ends[i] - n[i] + 1 : ends[i]]]
            more += rest
        if keys:
            both = np.concatenate(keys)
            yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in (np.concatenate(anchor), both[:, 0], both[:, 1], np.concatenate(place))), pa.array(more, pa.list_(pa.int64()))], ["anchor", "key", "key2", "place", "more"])


PASSAGE = "gid long, keys array<long>, keys2 array<long>, places array<long>, col0 int, passage binary"


def _passage_rows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(key, key2, text, at) -> PASSAGE rows: equal passages around one anchor are one row with all their owners.

    Around an anchor with several ways strings are dealt by where they start. All strings of a part hold its core, so
    the part's passages are grouped by the core's hash rather than by the anchor. Where a part has one start alone its
    string is replaced by a digest; ``col0`` is -1 - start.
    """
    side = length - GRAM
    held: dict[tuple, tuple[list, list, list]] = {}
    owners = 0
    for b in batches:
        for k, k2, text, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), b.column(3).to_pylist()):
            for x in at:
                ways = x["ways"] or side + 1
                for p in (x["place"], *(x["more"] or ())):
                    base = p - side
                    for i in range(ways):
                        lo, hi = i * (side + 1) // ways, (i + 1) * (side + 1) // ways - 1
                        gid = x["anchor"]
                        if ways > 1:
                            if base + hi < 0 or base + lo + length > len(text):
                                continue  # no string of this part lies in the text
                            gid = xxhash.xxh64_intdigest(text[base + hi : base + lo + length], lo) >> 1
                        passage = text[max(0, base + lo) : base + hi + length]
                        code = (gid, max(lo, -base), passage) if ways <= side else (gid, -1 - lo, hashlib.sha256(passage).digest())
                        own = held.setdefault(code, ([], [], []))
                        own[0].append(k), own[1].append(k2), own[2].append(p)
                        owners += 1
            if len(held) > COMBINED or owners > OWNERS:
                yield _batch(held)
                held, owners = {}, 0
    if held:
        yield _batch(held)


def _batch(held: dict) -> pa.RecordBatch:
    gid, col0, passage = zip(*held)
    lists = [pa.array(x, pa.list_(pa.int64())) for x in zip(*held.values())]
    return pa.RecordBatch.from_arrays([pa.array(gid, pa.int64()), *lists, pa.array(col0, pa.int32()), pa.array(passage, pa.binary())], ["gid", "keys", "keys2", "places", "col0", "passage"])


def repeated_starts(columns: np.ndarray, length: int, starts: int) -> np.ndarray:
    """columns[c, i]: symbol c of aligned passage i. True at [s, i] if the string at column s < starts has a like in another passage."""
    width, m = columns.shape
    found = np.zeros((starts, m), bool)
    order, lcp = np.arange(m), np.zeros(m, np.int16)  # lcp[r]: of the passages at ranks r - 1 and r
    for c in range(width - 1, -1, -1):
        symbol = columns[c, order]
        by = np.argsort(symbol, kind="stable")  # old ranks in their new order
        same = symbol[by][1:] == symbol[by][:-1]
        new = np.zeros(m, np.int16)
        new[1:][same] = 1 + _range_min(lcp, by[:-1][same] + 1, by[1:][same] + 1)
        order, lcp = order[by], new
        if c < starts:
            long = lcp >= length
            long[:-1] |= long[1:]
            found[c, order] = long
    return found


def _range_min(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least of x[lo:hi] for each pair, hi > lo, from tables of powers of two."""
    out = x[lo].copy()
    size = hi - lo
    level, n = x, 1
    while True:
        now = size >= n
        if not now.any():
            return out
        last = now & (size < 2 * n)
        out[last] = np.minimum(level[lo[last]], level[hi[last] - n])
        if len(level) <= n:
            return out
        level = np.minimum(level[:-n], level[n:])
        n *= 2


def _spans(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """All passages of whole groups -> (key, key2, start, stop) of covered bytes."""
    side = length - GRAM
    code: dict[tuple, int] = {}
    parts: list[tuple] = []
    for b in batches:
        # digests of different groups differ, as the group is a hash of the same string
        n = [code.setdefault(x, len(code)) for x in zip(b.column(4).to_pylist(), b.column(5).to_pylist())]
        lists = [b.column(i) for i in (1, 2, 3)]
        parts.append((np.repeat(np.array(n, np.int64), np.diff(lists[0].offsets.to_numpy())), *(x.flatten().to_numpy() for x in lists)))
    if not code:
        return
    which, key, key2, place = (np.concatenate(x) for x in zip(*parts))
    del parts
    many = np.bincount(which)  # equal passages are treated as one
    col0 = np.array([c for c, _ in code], np.int64)
    size = np.array([len(p) for _, p in code], np.int64)
    whole = np.flatnonzero(col0 >= 0)
    columns = np.full((side + length, len(whole)), OUTSIDE, np.uint16)
    for i, (c, p) in enumerate(x for x in code if x[0] >= 0):
        columns[c : c + len(p), i] = np.frombuffer(p, np.uint8)
    del code
    found = repeated_starts(columns, length, side + 1)
    del columns
    c = np.arange(side + 1)[:, None]
    last = col0[whole] + size[whole] - length  # last start inside the text
    found = (found | (many[whole] > 1)) & (c >= col0[whole]) & (c <= np.minimum(last, side))
    edge = np.diff(np.pad(found, ((1, 1), (0, 0))).astype(np.int8), axis=0)
    begin_i, begin_c = np.nonzero(edge.T == 1)
    begin_i, end_c = whole[begin_i], np.nonzero(edge.T == -1)[1] - 1
    single = np.flatnonzero((col0 < 0) & (many > 1))  # one start, and a digest that others have too
    begin_i, begin_c, end_c = (np.concatenate(x) for x in ((begin_i, single), (begin_c, -1 - col0[single]), (end_c, -1 - col0[single])))
    order = np.argsort(begin_i, kind="stable")
    begin_i, begin_c, end_c = begin_i[order], begin_c[order], end_c[order]
    # of each distinct passage its runs of starts; now for each of its owners
    runs = np.searchsorted(begin_i, [np.arange(len(many)), np.arange(len(many)) + 1])
    n_runs = (runs[1] - runs[0])[which]
    row = np.repeat(np.arange(len(which)), n_runs)
    if not len(row):
        return
    nth = np.arange(len(row)) - np.repeat(np.cumsum(n_runs) - n_runs, n_runs)
    run = runs[0][which[row]] + nth
    zero = place[row] - side  # of column 0
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key[row], key2[row], zero + begin_c[run], zero + end_c[run] + length)], ["key", "key2", "start", "stop"])


def merged(spans: list) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, kept = 0, []
    for a, b in spans:
        kept.append(text[at:a])
        at = b
    return b"".join([*kept, text[at:]])


def _digests(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    """(key, key2, text, spans) -> digest rows; with_text: the kept text too, without characters that lost a byte."""
    for b in batches:
        out = []
        for k, k2, text, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), b.column(3).to_pylist()):
            spans = merged([(x["start"], x["stop"]) for x in s])
            kept = without(text, spans)
            out.append((k, k2, len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if with_text else None))
        cols = list(zip(*out)) or [()] * 6
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["key", "key2", "n_removed", "n_spans", "kept_sha256", "kept_text"])


#: What a text is known by.
KEY = ["key", "key2"]


def _keys(sha) -> list:
    """120 bits of a SHA-256 in hex, as two numbers."""
    return [F.conv(F.substring(sha, 1 + 15 * i, 15), 16, 10).cast("long").alias(k) for i, k in enumerate(KEY)]


def _texts(docs: DataFrame) -> DataFrame:
    text = text_or_empty()
    return docs.select(*_keys(F.sha2(text, 256)), text.alias("text"))


def repeated_spans(docs: DataFrame, length: int = 200) -> DataFrame:
    """Rows ``(key, key2, start, stop)``: covered bytes of each distinct text, spans may overlap. Texts that occur as a whole more than once aren't treated here beyond their first copy."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = _texts(docs).mapInArrow(partial(_anchor_rows, length=length), "anchor long, key long, key2 long, place long, more array<long>")
    ends = [f(k).alias(f"{f.__name__}_{k}") for k in KEY for f in (F.min, F.max)]
    counts = rows.groupBy("anchor").agg(*ends, F.count("more").alias("twice"), F.count("*").alias("n")).where("min_key != max_key or min_key2 != max_key2 or twice > 0")
    ways = F.lit(1)
    for least, parts in LEVELS:
        ways = F.when(F.col("n") > least, parts).otherwise(ways)
    often = cut(counts.select("anchor", ways.alias("ways")))  # so that the join is of two shuffles alone, and a hot anchor can be split
    shared, drop = stored(rows.join(often.hint("merge"), "anchor").select(*KEY, "anchor", "place", "more", "ways"))
    parts = max(spark.sparkContext.defaultParallelism, -(-shared.count() // PASSAGES))
    shared = shared.dropDuplicates([*KEY, "anchor"])  # a text that several tasks have sent
    places = shared.groupBy(*KEY).agg(F.collect_list(F.struct("anchor", "place", "more", "ways")).alias("at"))
    texts = _texts(docs).join(places, KEY)
    passages = texts.select(*KEY, "text", "at").mapInArrow(partial(_passage_rows, length=length), PASSAGE)
    spans = cut(passages.repartition(parts, "gid").mapInArrow(partial(_spans, length=length), "key long, key2 long, start long, stop long"))
    drop()
    return spans


def _decisions(docs: DataFrame, keys: DataFrame, length: int, with_text: bool) -> DataFrame:
    """By key of the texts that lose something or occur more than once (n_removed -1); keys: one row per document."""
    copies = keys.groupBy(*KEY).agg(F.count("*").alias("n"))
    spans = repeated_spans(docs, length).groupBy(*KEY).agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    single = spans.join(copies.where("n = 1").select(*KEY), KEY, "left_semi")
    done = _texts(docs).join(single, KEY).select(*KEY, "text", "spans").mapInArrow(partial(_digests, with_text=with_text), "key long, key2 long, n_removed long, n_spans long, kept_sha256 string, kept_text string")
    return done.unionByName(copies.where("n > 1").select(*KEY, F.lit(-1).cast("long").alias("n_removed")), allowMissingColumns=True)


def remove_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``.

    A byte is removed if a string of ``length`` bytes that covers it starts anywhere else too, in any document or in
    the same one; strings are judged on the input and may overlap. Null texts count as empty; empty and short texts
    lose nothing; equal texts of ``length`` bytes or more lose everything. Repeated rows count as documents of their
    own. Texts may have any length: they are hashed in chunks. Other columns are ignored. An empty table gives an empty
    result.
    """
    small_batches(docs.sparkSession)
    text = text_or_empty()
    index = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("sha"))
    index = cut(index.select("*", *_keys(F.col("sha"))))
    done = _decisions(docs, index, length, False)
    whole = (F.col("n_removed") == -1) & (F.col("n_bytes") >= length)
    part = F.coalesce(F.col("n_removed"), F.lit(-1)) >= 0
    return index.join(done, KEY, "left").select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).when(part, F.col("n_removed")).otherwise(0).cast("long").alias("n_removed"),
        F.when(whole, 1).when(part, F.col("n_spans")).otherwise(0).cast("long").alias("n_spans"),
        F.when(whole, F.sha2(F.lit(""), 256)).when(part, F.col("kept_sha256")).otherwise(F.col("sha")).alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """The documents with what is left of their texts (as :func:`remove_repeats` decides) and its ``n_chars``.

    A character that lost some of its bytes is dropped. Texts that lose nothing stay as they are, nulls too. All rows
    and columns stay, of repeated rows each; columns may have any name that doesn't start with ``__``.
    """
    small_batches(docs.sparkSession)
    keys = cut(_texts(docs).select(*KEY))
    done = _decisions(docs, keys, length, True).select(F.col("key").alias("__of"), F.col("key2").alias("__of2"), F.col("n_removed").alias("__removed"), F.col("kept_text").alias("__kept"))
    text = text_or_empty()
    whole = (F.col("__removed") == -1) & (F.octet_length(text) >= length)
    left = F.when(whole, F.lit("")).when(F.col("__removed") >= 0, F.col("__kept")).otherwise(F.col("text"))
    own = _keys(F.sha2(text, 256))
    keyed = docs.withColumns({"__own": own[0], "__own2": own[1]})
    out = keyed.join(done, (F.col("__own") == F.col("__of")) & (F.col("__own2") == F.col("__of2")), "left").withColumn("text", left)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__removed").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long")))
    return out.select(*docs.columns)
