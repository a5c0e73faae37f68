"""I-Match fingerprints (DataFrame operations only).

Of a text's terms those within a band of inverse document frequency are kept, distinct and sorted. Each of several
random subsets of the lexicon gives a hash of the kept terms that are in it. Document frequencies are counted by the
64-bit hash of a term. At most the mean number of distinct terms of a document over the band's lower end can be kept,
whatever the number of documents. So the lexicon is a bounded table, and a literal.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm.common import cut, text_or_empty

#: Share of the documents that hold a kept term: the band of inverse document frequency is -ln of it.
BAND = (0.01, 0.3)
#: (number of subsets, each of one out of so many lexicon parts); the first level deals out the whole lexicon.
LEVELS = ((32, 32), (16, 128), (16, 512))
WORDS = r"[^\p{L}\p{N}]+"
#: Bytes of text that one task puts in order, about, ranges of doc_id of equal numbers of rows, and tasks at most: beyond,
#: each has more.
TASK_BYTES = 24 << 20
RANGES, TASKS = 128, 1 << 20


def hashes(text: Column) -> Column:
    return F.transform(F.filter(F.split(F.lower(text), WORDS), lambda w: w != ""), lambda w: F.xxhash64(w))


def document_frequencies(docs: DataFrame) -> DataFrame:
    """``(term, n)``: documents that hold the term, by its hash."""
    return docs.select(F.explode(F.array_distinct(hashes(text_or_empty()))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


class Lexicon:
    """A set of hashes as an array literal: ``slots`` places for each of a power of two of low bits, the first of them filled."""

    def __init__(self, terms: np.ndarray):
        self.low = (1 << max(1, 2 * len(terms)).bit_length()) - 1
        at = terms & self.low
        terms, at = terms[np.argsort(at, kind="stable")], np.sort(at)
        nth = np.arange(len(at)) - np.searchsorted(at, at)
        self.slots = int(nth.max(initial=0)) + 1
        table = np.repeat(np.arange(self.low + 1) ^ 1, self.slots).reshape(-1, self.slots)  # free: a hash of other low bits
        table[at, nth] = terms
        self.table = F.split(F.lit(",".join(map(str, table.ravel().tolist()))), ",").cast("array<bigint>")

    def holds(self, h: Column) -> Column:
        first = h.bitwiseAND(F.lit(self.low)) * self.slots
        return reduce(Column.__or__, (F.get(self.table, (first + i).cast("int")) == h for i in range(self.slots)))


def lexicon(docs: DataFrame, n_docs: int, band: tuple[float, float] = BAND) -> Lexicon:
    """The terms within the band. At most a document's mean number of distinct terms over ``band[0]`` come to the driver."""
    kept = document_frequencies(docs).where((F.col("n") >= band[0] * n_docs) & (F.col("n") <= band[1] * n_docs)).select("term")
    return Lexicon(np.sort(np.array([r[0] for r in kept.collect()], np.int64)))


def _subset(terms: Column) -> Column:
    """32 bits of the hash of one subset's sorted terms; 0 for none."""
    return F.when(F.size(terms) == 0, F.lit(0).cast("long")).otherwise(F.xxhash64(terms).bitwiseAND(F.lit(0xFFFFFFFE)) + 1)


def _within(terms: Column, shift: int, parts: int, which: int) -> Column:
    return F.filter(terms, lambda h: F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(parts - 1)) == which)


def with_fingerprint(df: DataFrame, text: str, out: str, kept: Lexicon) -> DataFrame:
    """Adds array<long> ``out``: the subsets' hashes, then the hash of all kept terms (of all terms if none is kept)."""
    df = df.withColumn("_all", hashes(F.col(text)))
    df = df.withColumn("_kept", F.sort_array(F.array_distinct(F.filter("_all", kept.holds))))
    # level by level: first into fewer parts, then each part into its subsets
    cols, df = [], df.withColumn("_whole", F.xxhash64(F.when(F.size("_kept") > 0, F.col("_kept")).otherwise(F.sort_array(F.array_distinct("_all")))))
    for level, (subsets, parts) in enumerate(LEVELS):
        shift = 17 + 12 * level
        step = max(1, subsets // 4)
        coarse = parts // step
        for a in range(subsets // step):
            name = f"_p{level}_{a}"
            df = df.withColumn(name, _within(F.col("_kept"), shift, coarse, a))
            cols += [_subset(_within(F.col(name), shift + (coarse - 1).bit_length(), step, b)) for b in range(step)]
    df = df.withColumn(out, F.array(*cols, F.col("_whole")))
    return df.drop("_all", "_kept", "_whole", *(f"_p{i}_{a}" for i in range(len(LEVELS)) for a in range(4)))


def likeness(a: Column, b: Column) -> Column:
    """Share of the subsets with a term in either text whose hashes are equal; 1 if all kept terms are."""
    n = sum(s for s, _ in LEVELS)
    either = F.slice(F.zip_with(a, b, lambda x, y: F.when((x == 0) & (y == 0), F.lit(None)).otherwise((x == y).cast("int"))), 1, n)
    some = F.filter(either, lambda x: x.isNotNull())
    share = F.aggregate(some, F.lit(0), lambda s, x: s + x) / F.size(some)
    return F.when(F.element_at(a, n + 1) == F.element_at(b, n + 1), F.lit(1.0)).when(F.size(some) == 0, F.lit(0.0)).otherwise(share)


def as_text(fp: Column) -> Column:
    return F.array_join(F.transform(fp, lambda x: F.lower(F.lpad(F.hex(x.bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))), "")


class Buckets:
    """Tasks of rows in order of (doc_id, hash of the text), rising with both; the null id is below all.

    A doc_id that spans several of the equal ranges is dealt out by the hash, as the null id is.
    """

    def __init__(self, docs: DataFrame):
        at = [i / RANGES for i in range(RANGES + 1)]
        self.rows, size, nulls, ends = docs.agg(F.count("*"), F.sum(F.octet_length("text").cast("long")), F.count_if(F.col("doc_id").isNull()), F.percentile_approx("doc_id", at, 10_000)).first()
        parts = max(1, min(TASKS, -(-(size or 0) // TASK_BYTES)) // RANGES)
        self.parts, self.ends = parts, sorted(set(ends or [0]))
        self.hot = [parts * ((ends or [0]).count(e) - 1) for e in self.ends]
        self.none = max(1, RANGES * parts * nulls // max(1, self.rows))
        self.first = [sum(self.hot[:i]) + parts * i for i in range(len(self.ends))]
        self.tasks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-(size or 0) // TASK_BYTES))

    def of(self, hash_: Column) -> Column:
        place = (F.shiftrightunsigned(hash_.bitwiseXOR(F.lit(-(1 << 63))), 1) / F.lit(2.0**63)).cast("double")  # 0 to 1
        lows, hot = F.array(*map(F.lit, self.ends)), F.array(*map(F.lit, self.hot))
        widths = F.array(*(F.lit(max(1, -(-(b - a) // self.parts))) for a, b in zip(self.ends, [*self.ends[1:], self.ends[-1] + 1])))
        at = F.greatest(F.size(F.filter(lows, lambda e: e <= F.col("doc_id"))) - 1, F.lit(0))
        far = F.col("doc_id") - F.get(lows, at)
        inside = F.get(hot, at) + F.greatest(F.lit(0), F.least(F.lit(self.parts - 1), F.floor(far / F.get(widths, at))))
        among = lambda n: F.least(n - 1, F.floor(place * n))
        inside = F.when((far == 0) & (F.get(hot, at) > 0), among(F.get(hot, at))).otherwise(inside)
        return F.when(F.col("doc_id").isNull(), among(F.lit(self.none)) - self.none).otherwise(F.get(F.array(*map(F.lit, self.first)), at) + inside).cast("int")


def neighbours(docs: DataFrame) -> tuple[DataFrame, int]:
    """Rows ``(bucket, doc_id, text, hash, guard)`` and the number of documents.

    In each bucket the row that follows its last one, by falling doc_id, is there as a guard, so that whole order is
    the buckets' own. After the least doc_id comes the largest; null ids are the least; equal ids are in falling order
    of their texts' hashes.
    """
    buckets = Buckets(docs)
    rows = docs.select("doc_id", text_or_empty().alias("text"), F.xxhash64(text_or_empty()).alias("hash"), F.lit(False).alias("guard")).withColumn("bucket", buckets.of(F.col("hash")))
    heads = cut(rows.groupBy("bucket").agg(F.max(F.struct("doc_id", "hash")).alias("head")))  # one row for each task
    order = Window.orderBy(F.desc("bucket"))
    of = heads.select(F.col("head"), F.col("bucket").alias("own"), F.coalesce(F.lag("bucket").over(order), F.min("bucket").over(Window.partitionBy())).alias("before"))
    follows = rows["doc_id"].eqNullSafe(of["head.doc_id"]) & (rows["hash"] == of["head.hash"]) & (rows["bucket"] == of["own"])
    guards = rows.join(F.broadcast(of), follows).select("doc_id", "text", "hash", F.lit(True).alias("guard"), F.col("before").alias("bucket"))  # at most about TASKS rows
    return rows.unionByName(guards).repartition(buckets.tasks, "bucket"), buckets.rows


def fingerprints(docs: DataFrame, band: tuple[float, float] = BAND) -> DataFrame:
    """One row per document: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.

    The edited text is the text with its last third replaced by the start of the next document, by falling doc_id.
    Null texts count as empty. Texts without a kept term have the hash of all their terms and no subset; empty texts
    are alike. Equal texts have equal fingerprints. A single document is its own next. Repeated rows count as
    documents of their own, next to each other. Of a text all terms count, however long it is; a text moves once. Other
    columns are ignored; an empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows, n = neighbours(docs)
    kept = lexicon(docs, n, band)
    order = Window.partitionBy("bucket").orderBy("guard", F.desc_nulls_last("doc_id"), F.desc("hash"))
    rows = with_fingerprint(rows, "text", "fp", kept)
    rows = rows.withColumn("next_text", F.lead("text").over(order)).withColumn("next_fp", F.lead("fp").over(order)).where(~F.col("guard"))
    length = F.char_length("text")
    third = F.floor(length / 3).cast("int")
    rows = rows.withColumn("n_chars", length.cast("long")).withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), length - third), F.substring(F.col("next_text"), F.lit(1), third)))
    rows = with_fingerprint(rows.drop("text", "next_text"), "edited", "edited_fp", kept)
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("fp")).alias("fingerprint"),
        as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).cast("double").alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).cast("double").alias("near_next"),
    )
