"""Uniform shuffle into shards of exact size through a hypergeometric communication matrix.

Rows lie in source partitions (by a hash of their content). How many rows of each partition go to each shard is
drawn exactly: a partition's row of the matrix is multivariate hypergeometric given the room that is left in the
shards. Each partition permutes its rows and deals them out by its counts; each shard permutes what it got again.
The driver sees the matrix alone: the number of partitions times the number of shards. A draw's probability comes from
saddle-point expansions, in which large logarithms don't cancel.
"""

from __future__ import annotations

from math import exp, lgamma, log, log1p, pi

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm.common import cut, share, text_or_empty

#: Rows that one task permutes, about; there is a source partition for each so many rows.
ROWS = 100_000


def _stirling_error(n: float) -> float:
    """ln n! less Stirling's approximation."""
    if n < 16:
        return lgamma(n + 1) - ((n + 0.5) * log(n) - n + 0.5 * log(2 * pi)) if n else 0.0
    x = 1 / (n * n)
    return (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680) * x) * x) * x) / n


def _deviance(x: float, mean: float) -> float:
    """x ln(x / mean) + mean - x, without cancellation."""
    e = (x - mean) / mean
    if abs(e) > 0.1:
        return x * log(x / mean) + mean - x
    total, power, k = 0.0, e * e, 2
    while abs(power) > 1e-18 * max(total, 1e-300):  # (1 + e) ln(1 + e) - e as a series
        total += power / (k * (k - 1)) * (1 if k % 2 == 0 else -1)
        power, k = power * e, k + 1
    return mean * total


def _log_binomial(x: int, n: int, p: float, q: float) -> float:
    """ln of the binomial probability of x out of n by its saddle point: as exact for 10**15 as for 10."""
    if x == 0:
        return n * (log1p(-p) if p < 0.5 else log(q))
    if x == n:
        return n * (log1p(-q) if q < 0.5 else log(p))
    error = _stirling_error(n) - _stirling_error(x) - _stirling_error(n - x)
    return error - _deviance(x, n * p) - _deviance(n - x, n * q) + 0.5 * (log(n) - log(2 * pi) - log(x) - log(n - x))


def log_probability(k: int, good: int, bad: int, drawn: int) -> float:
    """ln of the chance that k of ``drawn`` out of good + bad are good, as a ratio of binomial probabilities."""
    n = good + bad
    if drawn == n:
        return 0.0
    p, q = drawn / n, (n - drawn) / n
    return _log_binomial(k, good, p, q) + _log_binomial(drawn - k, bad, p, q) - _log_binomial(drawn, n, p, q)


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """How many of ``drawn`` out of good + bad are good: inversion from the mode outwards."""
    lo, hi = max(0, drawn - bad), min(drawn, good)
    if lo == hi:
        return lo
    mode = min(hi, max(lo, (drawn + 1) * (good + 1) // (good + bad + 2)))
    p = exp(log_probability(mode, good, bad, drawn))
    u = rng.random() - p
    up = down = mode
    p_up = p_down = p
    while u > 0 and (up < hi or down > lo):
        if up < hi:
            p_up *= (good - up) / (up + 1) * (drawn - up) / (bad - drawn + up + 1)
            up += 1
            u -= p_up
            if u <= 0:
                return up
        if down > lo:
            p_down *= down / (good - down + 1) * (bad - drawn + down) / (drawn - down + 1)
            down -= 1
            u -= p_down
            if u <= 0:
                return down
        if max(p_up, p_down) < 1e-300:
            break
    return mode


def communication_matrix(sources: list[int], shards: list[int], seed: int) -> np.ndarray:
    """Exact counts of rows from each source to each shard; rows sum to the sources, columns to the shards."""
    rng = np.random.default_rng(seed)
    room, out = list(shards), np.zeros((len(sources), len(shards)), np.int64)
    for i, n in enumerate(sources):
        rest = sum(room)
        for j in range(len(room)):
            rest -= room[j]
            out[i, j] = k = hypergeometric(rng, room[j], rest, n)
            room[j] -= k
            n -= k
    return out


def shard(docs: DataFrame, shards: int = 16, seed: int = 7) -> DataFrame:
    """One row per document: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    Shard sizes differ by one row at most (law ``rows``); slots run from 0 without gaps in each shard and are a
    uniform permutation. Size is the UTF-8 bytes of the text plus 1; a null text has none. The result depends on the
    rows and the seed, not on how they are read; of rows that are equal in every used column, which gets which slot
    isn't defined, and they are permuted in one task, as rows of 40 bytes. Texts may have any length; only their size
    and checksum move. Null doc_ids are kept. Other columns are ignored. An empty table gives an empty result. The
    driver makes the matrix, a row of ``shards`` numbers for each ROWS rows, and tasks get it (25 MB at 2 * 10**10 rows).
    """
    spark = docs.sparkSession
    text = text_or_empty()
    rows = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")).withColumn("h", F.xxhash64("doc_id", "size", "text_crc32")))
    n = rows.count()
    parts = max(1, -(-n // ROWS))
    rows = rows.withColumn("source", F.pmod("h", F.lit(parts)).cast("int"))
    sizes = dict(rows.groupBy("source").count().collect())
    sources = [sizes.get(i, 0) for i in range(parts)]
    matrix = communication_matrix(sources, [n // shards + (j < n % shards) for j in range(shards)], seed)
    ends = spark.createDataFrame([(i, [int(x) for x in r]) for i, r in enumerate(matrix.cumsum(axis=1))], "source int, ends array<long>")
    local = Window.partitionBy("source").orderBy(share(F.col("h"), seed), "h", "doc_id")
    dealt = rows.withColumn("place", F.row_number().over(local)).join(F.broadcast(ends), "source")  # a row for each ROWS rows
    dealt = dealt.withColumn("shard", F.size(F.filter("ends", lambda e: e < F.col("place"))))
    fine = max(1, -(-n // shards // ROWS))
    dealt = dealt.withColumn("key", share(F.col("h"), seed + 1)).withColumn("bucket", F.floor(F.col("key") * fine).cast("int")).select("doc_id", "size", "text_crc32", "shard", "bucket", "key", "h")
    dealt = cut(dealt)
    counts = dealt.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = counts.select("shard", "bucket", F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("key", "h", "doc_id")))
    return ranked.join(before, ["shard", "bucket"]).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.coalesce("before", F.lit(0)) + F.col("rank") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
