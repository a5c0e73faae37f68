"""Quality by an interpolated modified Kneser-Ney model of word pairs, trained on trusted text.

Nothing has a fixed size: counts, contexts and probabilities are tables sharded by word and by pair, which grow with the
trusted text. A language has a model of its own if it has enough trusted documents.

1. Blocks of texts count the pairs of their trusted texts. Shards, by a pair's first word, sum the counts; from the
   distinct pairs they tell the second words' shards in how many left contexts each word is found.
2. Shards make the model's entries: a pair's own discounted share, a word's lower-order probability, and the weight
   that a context leaves to the lower order.
3. Blocks ask the shards for each distinct word and pair of their texts once. A shard holds its part of the entries and
   answers requests as they stream by; blocks add up the log probabilities of their documents.
4. Perplexities are compared with quantiles of the same model's trusted documents that it wasn't trained on.

Words are known by 48 bits of a hash that differs by model; a pair that the model hasn't is taken for one that it has
with a chance of its number of pairs over 2**48. Requests travel as sorted, packed keys, answers in the order asked.
Texts move into blocks compressed, a part of the blocks at a time, and nothing of the model is broadcast.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, partial, reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import cut, share, small_batches, stored

#: Trusted documents of a language below which it has no model of its own; such languages share one.
LEAST = 30
OTHER = "*"
#: Share of the trusted documents that the models aren't trained on; thresholds come from these.
HELD = 0.2
#: Quantile of a model's held-out trusted perplexities up to which documents are kept.
QUANTILE = 0.99
#: Bytes of text in a block, and of a shard's part of all text.
BLOCK = 12 << 20
#: Parts of the blocks, and of the shards, that are done one after another when pairs are counted and when texts are
#: scored: what moves at once is bounded by them; each part reads the texts anew.
ROUNDS = (4, 10)
#: Bytes of texts that are split into words at once.
CHUNK = 1 << 20
#: Answers are whole numbers of so many to a unit of the natural logarithm.
STEPS = 512
#: Bits of a hash that aren't sent.
UNSENT = np.uint64(16)
BLANK = re.compile(rb"[\x20\x09-\x0D]")
IS_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: A word's hash is a polynomial of its bytes in this number, mixed.
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Before a text and at its end: no word's polynomial is mixed with these.
START, END = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(n, base, np.uint64)], dtype=np.uint64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64; those of ordinary chunks are kept."""
    return _kept_tables() if n <= 2 * CHUNK else (_powers(int(BASE), n), _powers(pow(int(BASE), -1, 1 << 64), n))


@lru_cache(maxsize=1)
def _kept_tables() -> tuple[np.ndarray, np.ndarray]:
    return _powers(int(BASE), 2 * CHUNK), _powers(pow(int(BASE), -1, 1 << 64), 2 * CHUNK)


def word_keys(data: np.ndarray, model: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the words of some bytes, and their keys."""
    blank = np.r_[True, IS_BLANK[data], True]
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    start, stop = edge[::2], edge[1::2]
    up, down = _tables(len(data))
    sums = np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64)]
    return start, _mixed(_mixed((sums[stop] - sums[start]) * down[start]) + np.uint64(model)) >> UNSENT


def _edge(place: np.uint64, model: int) -> np.uint64:
    return (_mixed(np.array([place]) + np.uint64(model)) >> UNSENT)[0]


def _pieces(texts: Iterator[bytes]) -> Iterator[list[tuple[int, bytes, bool]]]:
    """Lists of (text's number, piece, whether it is the text's last), of about CHUNK bytes; pieces end at blanks."""
    held, size = [], 0
    for i, text in enumerate(texts):
        at = 0
        while True:
            stop = BLANK.search(text, at + CHUNK) if len(text) > at + CHUNK else None
            end = stop.start() if stop else len(text)
            held.append((i, text[at:end], stop is None))
            size += end - at + 1
            if size >= CHUNK:
                yield held
                held, size = [], 0
            if stop is None:
                break
            at = end
    if held:
        yield held


def pairs(texts: Iterator[bytes], model: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text's number, key of a word, key of the next) for all words and the places before and after a text, in chunks."""
    first, end = int(_edge(START, model)), int(_edge(END, model))
    before = first
    for held in _pieces(texts):
        size = np.array([len(p) + 1 for _, p, _ in held])
        start, key = word_keys(np.frombuffer(b" ".join(p for _, p, _ in held), np.uint8), model)
        n = np.diff(np.searchsorted(start, np.r_[0, np.cumsum(size)]))
        last = np.array([x for _, _, x in held])
        places = n + last  # a piece's words, and the end of its text
        stops = np.cumsum(places)
        if not stops[-1]:
            continue  # blanks inside a text
        b = np.empty(int(stops[-1]), np.uint64)
        is_end = np.zeros(len(b), bool)
        is_end[stops[last] - 1] = True
        b[is_end], b[~is_end] = end, key
        a = np.r_[np.uint64(before), b[:-1]]
        a[1:][is_end[:-1]] = first
        before = first if is_end[-1] else int(b[-1])
        yield np.repeat(np.array([i for i, _, _ in held]), places), a, b


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _mixed(a * BASE + b)


#: Distinct pairs in order of their hash: hash, first and second word, count.
Counts = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def summed(parts: list[Counts]) -> Counts:
    if not parts:
        return tuple(np.empty(0, np.uint64) for _ in range(3)) + (np.empty(0, np.int64),)
    h, a, b, n = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(h)
    h = h[order]
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.empty(0, np.int64)
    return h[first], a[order[first]], b[order[first]], np.add.reduceat(n[order], first) if len(first) else n


def counted(texts: Iterator[bytes], model: int) -> Counts:
    parts: list[Counts] = []
    for _, a, b in pairs(texts, model):
        parts.append(summed([(pair_hash(a, b), a, b, np.ones(len(a), np.int64))]))
        if len(parts) > 15:
            parts = [summed(parts)]
    return summed(parts)


def _pack(x: np.ndarray) -> bytes:
    """Whole numbers by byte planes, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.astype(np.int64).view(np.uint8).reshape(-1, 8).T).tobytes())


def _unpack(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8).reshape(8, -1).T).view(np.int64).ravel()


def _pack_keys(keys: np.ndarray) -> bytes:
    """Keys in order."""
    return _pack(np.diff(keys.astype(np.int64), prepend=0))


def _unpack_keys(x: bytes) -> np.ndarray:
    return np.cumsum(_unpack(x)).astype(np.uint64)


def _by_shard(shard: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, places of its entries in their order)."""
    order = np.argsort(shard, kind="stable")
    at = np.searchsorted(shard[order], np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(at)):
        yield int(s), order[at[s] : at[s + 1]]


def _shard(key: np.ndarray, shards: int) -> np.ndarray:
    return (key % np.uint64(shards)).astype(np.int64)


#: What moves between blocks and shards. kind: counts of pairs (keys: first words, more: second words, n), left contexts
#: of words (keys, n), entries of pairs, contexts and words (keys, n: steps), or requests (keys: words, more: pairs).
MOVED = (("shard", pa.int64()), ("kind", pa.int32()), ("block", pa.int64()), ("model", pa.int64()), ("keys", pa.binary()), ("more", pa.binary()), ("n", pa.binary()))
COUNTS, CONTEXTS, OWN, BACK, LOW, REQUEST = range(6)
SCHEMA = "shard long, kind int, block long, model long, keys binary, more binary, n binary"
ANSWER = (("block", pa.int64()), ("shard", pa.int64()), ("model", pa.int64()), ("words", pa.binary()), ("pairs", pa.binary()))


def _table(rows: list[tuple], columns=MOVED) -> pa.Table:
    cols = list(zip(*rows)) or [()] * len(columns)
    return pa.table({name: pa.array(c, t) for (name, t), c in zip(columns, cols)})


def _by_model(docs: pa.Table) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for i, m in enumerate(docs.column("model").to_pylist()):
        out.setdefault(m, []).append(i)
    return out


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=3)
    for b in batches:
        text = pa.array((press.compress(x.as_py().encode()) for x in b.column("text")), pa.binary())
        yield b.set_column(b.schema.get_field_index("text"), "text", text)


def _texts(docs: pa.Table, rows: list[int]) -> Iterator[bytes]:
    text, press = docs.column("text"), zstandard.ZstdDecompressor()
    return (press.decompress(text[i].as_py()) for i in rows)


# -- the model -------------------------------------------------------------------------------------------------------


def _count_block(docs: pa.Table, good: pa.Table, shards: int) -> pa.Table:
    """Counts of the block's trusted pairs, by the first word's shard."""
    trusted = set(good.column("doc_id").to_pylist())
    ids, out = docs.column("doc_id").to_pylist(), []
    for model, rows in _by_model(docs).items():
        h, a, b, n = counted(_texts(docs, [i for i in rows if ids[i] in trusted]), model)
        order = np.argsort(a, kind="stable")
        a, b, n = a[order], b[order], n[order]
        out += [(s, COUNTS, -1, model, _pack_keys(a[at]), _pack(b[at]), _pack(n[at])) for s, at in _by_shard(_shard(a, shards), shards)]
    return _table(out)


def _read_counts(moved: pa.Table) -> dict[int, Counts]:
    parts: dict[int, list[Counts]] = {}
    for model, keys, more, n in zip(*(moved.column(c).to_pylist() for c in ("model", "keys", "more", "n"))):
        a, b = _unpack_keys(keys), _unpack(more).astype(np.uint64)
        held = parts.setdefault(model, [])
        held.append((pair_hash(a, b), a, b, _unpack(n)))
        if len(held) > 63:
            held[:] = [summed(held)]
    return {model: summed(p) for model, p in parts.items()}


STATS = tuple((f"n{i}", pa.int64()) for i in (1, 2, 3, 4)) + (("entries", pa.int64()), ("total", pa.int64()))
WITH_STATS = SCHEMA + "".join(f", {c} long" for c, _ in STATS)


def _stats(n: np.ndarray) -> tuple[int, ...]:
    return *(int((n == i).sum()) for i in (1, 2, 3, 4)), len(n), int(n.sum())


def _sum_counts(moved: pa.Table, shards: int) -> pa.Table:
    """All counts of a shard -> the same summed, and for the second words' shards the numbers of distinct pairs."""
    shard, out = moved.column("shard")[0].as_py(), []
    for model, (h, a, b, n) in _read_counts(moved).items():
        order = np.argsort(a, kind="stable")
        out.append((shard, COUNTS, -1, model, _pack_keys(a[order]), _pack(b[order]), _pack(n[order]), *_stats(n)))
        word, contexts = np.unique(b, return_counts=True)
        out += [(s, CONTEXTS, shard, model, _pack_keys(word[at]), None, _pack(contexts[at]), *(None,) * len(STATS)) for s, at in _by_shard(_shard(word, shards), shards)]
    return _table(out, MOVED + STATS)


def _sum_contexts(moved: pa.Table) -> pa.Table:
    shard, parts = moved.column("shard")[0].as_py(), {}
    for model, keys, n in zip(*(moved.column(c).to_pylist() for c in ("model", "keys", "n"))):
        parts.setdefault(model, []).append((_unpack_keys(keys), _unpack(n)))
    out = []
    for model, p in parts.items():
        k, n = (np.concatenate(x) for x in zip(*p))
        word, at = np.unique(k, return_inverse=True)
        n = np.bincount(at, weights=n).astype(np.int64)
        out.append((shard, CONTEXTS, -1, model, _pack_keys(word), None, _pack(n), *_stats(n)))
    return _table(out, MOVED + STATS)


class Discounts:
    """Discounts of one order from the numbers of entries that were counted once, twice, three and four times."""

    def __init__(self, n1: int, n2: int, n3: int, n4: int, entries: int, total: int):
        n = (n1, n2, n3, n4)
        y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
        self.less = np.array([0.0] + [max(0.1, min(i - (i + 1) * y * n[i] / n[i - 1] if n[i - 1] else i / 2, 0.9 * i)) for i in (1, 2, 3)])
        self.entries, self.total = entries, total
        #: What the discounts free in all.
        self.spare = float(self.less[1:] @ [n1, n2, entries - n1 - n2])

    def of(self, n: np.ndarray) -> np.ndarray:
        return self.less[np.minimum(n, 3)]

    def unseen(self) -> float:
        """What a word without a left context gets; one place more than words is for all such words."""
        return self.spare / self.total / (self.entries + 1)


def _entries(batches: Iterator[pa.RecordBatch], stats: dict[int, tuple[Discounts, Discounts]], shards: int) -> Iterator[pa.RecordBatch]:
    """Summed counts -> entries, pairs by their own shards."""
    for rows in batches:
        for shard, kind, model, keys, more, n in zip(*(rows.column(rows.schema.get_field_index(c)).to_pylist() for c in ("shard", "kind", "model", "keys", "more", "n"))):
            first, second = stats[model]
            keys, n, out = _unpack_keys(keys), _unpack(n), []
            if kind == CONTEXTS:
                low = (n - first.of(n)) / first.total + first.unseen()
                out.append((shard, LOW, -1, model, _pack_keys(keys), None, _pack(_steps(low))))
            else:
                context, at = np.unique(keys, return_inverse=True)
                total, spare = np.bincount(at, weights=n), np.bincount(at, weights=second.of(n))
                out.append((shard, BACK, -1, model, _pack_keys(context), None, _pack(_steps(spare / total))))
                own = _steps((n - second.of(n)) / total[at])
                pair = pair_hash(keys, _unpack(more).astype(np.uint64)) >> UNSENT
                order = np.argsort(pair)
                pair, own = pair[order], own[order]
                out += [(s, OWN, -1, model, _pack_keys(pair[i]), None, _pack(own[i])) for s, i in _by_shard(_shard(pair, shards), shards)]
            yield from _table(out).to_batches()


class ShardEntries:
    """One model's entries of a shard: keys and steps by kind."""

    def __init__(self, unseen: int):
        self.held: dict[int, list] = {OWN: [], BACK: [], LOW: []}
        self.otherwise = {OWN: 0, BACK: 1, LOW: unseen}  # steps: no share of its own, all weight, an unknown word
        self.ready = False

    def add(self, kind: int, keys: np.ndarray, steps: np.ndarray) -> None:
        self.held[kind].append((keys, steps.astype(np.int32)))

    def look(self, kind: int, keys: np.ndarray) -> np.ndarray:
        if not self.ready:
            for k, parts in self.held.items():
                known, steps = (np.concatenate(x) for x in zip(*parts)) if parts else (np.empty(0, np.uint64), np.empty(0, np.int32))
                order = np.argsort(known)
                self.held[k] = [known[order], steps[order]]
            self.ready = True
        return _look(*self.held[kind], keys, self.otherwise[kind])


def _look(known: np.ndarray, value: np.ndarray, keys: np.ndarray, otherwise: int) -> np.ndarray:
    if not len(known):
        return np.full(len(keys), otherwise)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, value[at], otherwise)


def _steps(p: np.ndarray) -> np.ndarray:
    """-ln of probabilities in steps, one more than they are; 0 for probability 0."""
    return np.where(p > 0, np.round(-np.log(np.maximum(p, 1e-300)) * STEPS) + 1, 0).astype(np.int64)


def _probability(steps: np.ndarray) -> np.ndarray:
    return np.where(steps > 0, np.exp((1 - steps) / STEPS), 0.0)


def _ask_block(docs: pa.Table, shards: int) -> pa.Table:
    """Requests of the block's distinct words and pairs."""
    out, block = [], docs.column("block")[0].as_py() if docs.num_rows else 0
    for model, rows in _by_model(docs).items():
        h, _, b, _ = counted(_texts(docs, rows), model)
        for s, words, _, pair_keys, _ in _asked(h, _words(b, model), shards):
            out.append((s, REQUEST, block, model, _pack_keys(words), _pack_keys(pair_keys), None))
    return _table(out)


def _words(b: np.ndarray, model: int) -> np.ndarray:
    """Keys of all words of distinct pairs in order: each word follows another one or the start."""
    return np.unique(np.r_[b, _edge(START, model)])


def _asked(h: np.ndarray, words: np.ndarray, shards: int) -> Iterator[tuple]:
    """Of each shard its words and pair keys in order, with their places among the block's words and pairs (in order of hash)."""
    pair_keys = h >> UNSENT
    of_word, of_pair = dict(_by_shard(_shard(words, shards), shards)), dict(_by_shard(_shard(pair_keys, shards), shards))
    none = np.empty(0, np.int64)
    for s in sorted(of_word.keys() | of_pair.keys()):
        w, p = of_word.get(s, none), of_pair.get(s, none)
        yield s, words[w], w, pair_keys[p], p


def _answered(batches: Iterator[pa.RecordBatch], unseen: dict[int, int]) -> Iterator[pa.RecordBatch]:
    """Rows in order of shard and kind -> answers. A task holds one shard's entries; requests stream by."""
    shard, models = None, {}
    for rows in batches:
        out = []
        for s, kind, block, model, keys, more, n in zip(*(rows.column(i).to_pylist() for i in range(7))):
            if s != shard:
                shard, models = s, {m: ShardEntries(x) for m, x in unseen.items()}
            if model not in models:
                continue  # a model without trusted text
            if kind != REQUEST:
                models[model].add(kind, _unpack_keys(keys), _unpack(n))
            else:
                words, own = _unpack_keys(keys), models[model].look(OWN, _unpack_keys(more))
                out.append((block, s, model, _pack(np.r_[models[model].look(LOW, words), models[model].look(BACK, words)]), _pack(own)))
        yield from _table(out, ANSWER).to_batches()


def _score_block(docs: pa.Table, got: pa.Table, shards: int) -> pa.Table:
    answers = {(m, s): (w, p) for m, s, w, p in zip(*(got.column(x).to_pylist() for x in ("model", "shard", "words", "pairs")))}
    known = {m for m, _ in answers}
    perplexity: list = [None] * docs.num_rows
    for model, rows in _by_model(docs).items():
        if model not in known:
            continue  # a model without trusted text
        places, parts = [], []
        for doc, a, b in pairs(_texts(docs, rows), model):
            hashes = pair_hash(a, b)
            places.append((doc.astype(np.int32), hashes))
            parts.append(summed([(hashes, a, b, np.ones(len(a), np.int64))]))
        h, a, b, _ = summed(parts)
        del parts
        words = _words(b, model)
        low, back, own = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), np.zeros(len(h), np.int64)
        for s, _, w, _, p in _asked(h, words, shards):
            word_steps, pair_steps = map(_unpack, answers[model, s])
            low[w], back[w] = np.split(word_steps, 2)
            own[p] = pair_steps
        logs = -np.log(_probability(own) + _probability(back)[np.searchsorted(words, a)] * _probability(low)[np.searchsorted(words, b)])
        total, n = np.zeros(len(rows)), np.zeros(len(rows))
        for doc, hashes in places:
            order = np.argsort(hashes)
            at = np.empty(len(order), np.int64)
            at[order] = np.searchsorted(h, hashes[order])  # in order, so that the search stays in the cache
            total += np.bincount(doc, weights=logs[at], minlength=len(rows))
            n += np.bincount(doc, minlength=len(rows))
        for i, x in zip(rows, np.exp(total / n)):
            perplexity[i] = float(x)
    return pa.table({"doc_id": docs.column("doc_id"), "model": docs.column("model"), "perplexity": pa.array(perplexity, pa.float64())})


def quality(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, block: int = BLOCK, least: int = LEAST) -> DataFrame:
    """One row per document: ``doc_id, model, perplexity, kept``.

    Trusted documents have a label ``quality`` 1. The model is the document's language; null languages and those with
    fewer than ``least`` trusted documents share the model ``*``, trained on their trusted texts, and its threshold.
    Null and empty texts are scored as the end of text alone. Texts may have any length: they are split in chunks.
    Where a model has no trusted text, perplexities are null; without held-out trusted text of a model all its
    documents are kept. A document at the threshold is kept. Repeated rows stay repeated and other columns are ignored.
    An empty table gives an empty result. The driver sees the languages with ``least`` trusted documents, and six
    numbers of each order of their models.
    """
    spark = docs.sparkSession
    small_batches(spark)
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit(OTHER)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    held = share(F.col("doc_id"), 13) < HELD
    trusted = rows.select("doc_id", "lang").where(~held).join(good.where(~held).hint("merge"), "doc_id", "left_semi")  # labels grow with the documents
    sizes = trusted.groupBy("lang").agg(F.count("*").alias("docs")).where(F.col("docs") >= least).where(F.col("lang") != OTHER)
    own = [OTHER, *sorted(r["lang"] for r in sizes.collect())]
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    blocks = shards = max(spark.sparkContext.defaultParallelism, -(-total // block))

    at = lambda x: F.pmod(x, F.lit(blocks)).cast("long").alias("block")
    model = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for i, name in enumerate(own) for x in (name, i))), F.col("lang")), F.lit(0)).cast("long").alias("model")
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))
    placed = rows.select("doc_id", model, "text", at(spread))
    labelled = good.where(~held).select("doc_id", at(F.xxhash64("doc_id")))

    counting, scoring = (min(x, blocks) for x in ROUNDS)

    def texts(i: int, rounds: int):
        return placed.where(F.col("block") % rounds == i).mapInArrow(_compressed, "doc_id long, model long, text binary, block long").groupBy("block")

    counts = [stored(texts(i, counting).cogroup(labelled.where(F.col("block") % counting == i).groupBy("block")).applyInArrow(lambda docs, good: _count_block(docs, good, shards), SCHEMA)) for i in range(counting)]
    counted_ = reduce(DataFrame.unionByName, (c for c, _ in counts))
    sums = [stored(counted_.where(F.col("shard") % counting == i).groupBy("shard").applyInArrow(lambda moved: _sum_counts(moved, shards), WITH_STATS)) for i in range(counting)]
    for _, drop in counts:
        drop()
    pairs_summed = reduce(DataFrame.unionByName, (x for x, _ in sums))
    words_summed, drop_words = stored(pairs_summed.where(F.col("kind") == CONTEXTS).select(*(c for c, _ in MOVED)).groupBy("shard").applyInArrow(_sum_contexts, WITH_STATS))
    both = pairs_summed.where(F.col("kind") == COUNTS).unionByName(words_summed)
    met = both.groupBy("model", "kind").agg(*(F.sum(c).alias(c) for c, _ in STATS)).collect()
    orders = {(r["model"], r["kind"]): Discounts(*(r[c] for c, _ in STATS)) for r in met}
    stats = {m: (orders[m, CONTEXTS], orders[m, COUNTS]) for m, kind in orders if kind == COUNTS}
    entries, drop_entries = stored(both.mapInArrow(partial(_entries, stats=stats, shards=shards), SCHEMA))
    for _, drop in sums:
        drop()
    drop_words()

    unseen = {m: int(_steps(np.array([first.unseen()]))[0]) for m, (first, _) in stats.items()}
    parts = []
    for i in range(scoring):
        asked = texts(i, scoring).applyInArrow(lambda docs: _ask_block(docs, shards), SCHEMA)
        in_order = entries.unionByName(asked).repartition(shards, "shard").sortWithinPartitions("shard", "kind")
        answers, drop_answers = stored(in_order.mapInArrow(partial(_answered, unseen=unseen), "block long, shard long, model long, words binary, pairs binary"))
        parts.append(cut(texts(i, scoring).cogroup(answers.groupBy("block")).applyInArrow(lambda docs, got: _score_block(docs, got, shards), "doc_id long, model long, perplexity double")))
        drop_answers()
    drop_entries()
    scored = reduce(DataFrame.unionByName, parts)
    limits = scored.join(good.where(held).hint("merge"), "doc_id", "left_semi").groupBy("model").agg(F.percentile_approx("perplexity", quantile, 10_000).alias("high"))
    name = F.element_at(F.array(*map(F.lit, own)), F.col("model").cast("int") + 1).alias("model")
    return scored.join(F.broadcast(limits), "model", "left").select("doc_id", name, "perplexity", F.coalesce(F.col("perplexity") <= F.col("high"), F.lit(True)).alias("kept"))
