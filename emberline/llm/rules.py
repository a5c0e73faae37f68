"""Quality rules: an isolation forest over rule statistics of whole texts, calibrated on labelled rows.

The forest is grown on a bounded sample of documents (``SAMPLE``, dealt by a hash of doc_id); a document's anomaly
score comes from its mean path length. The threshold is the one that best separates all labelled good and bad rows
among those that lose at most ``LOST`` of the good ones; it lies between two of ``BINS`` equal bins of their scores.
Statistics and verdicts cover every document.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.functions.forest import Forest
from emberline.llm.common import cut, share, small_batches

TREES, DRAWN = 200, 128
#: Documents that the forest is grown on, about.
SAMPLE = 12_000
#: Bins of scores in which labelled rows are counted: a bound on what comes to the driver, not on the rows.
BINS = 1 << 16
#: Share of good labelled rows that the threshold may cost.
LOST = 0.01
WINDOW = 5
SYMBOLS = b"#*$%&|<>"
SPACES = " \t\n\v\f\r"
#: Shares that the forest sees.
SHARES = 13
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MEASURES = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)
UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
PUNCT = re.compile(r"[^\w\s]")
DIGIT = re.compile(r"[0-9]")


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of words which the text holds twice or more."""
    if len(words) <= window:
        return 0
    grams = list(zip(*(words[i:] for i in range(window))))
    if len(set(grams)) == len(grams):
        return 0
    count = Counter(grams)
    covered, until = 0, 0
    for i, g in enumerate(grams):
        if count[g] > 1:
            covered += i + window - max(i, until)
            until = i + window
    return covered


def statistics(text: str) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """The base counts, and the shares that the forest sees."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    repeat = repeated_words(words)
    upper, punct, digit = (len(p.findall(text)) for p in (UPPER, PUNCT, DIGIT))
    c, w, k = max(1, chars), max(1, n), max(1, len(lines))
    marked = sum(not x[-1:].isalnum() and x[-1] < 128 for x in words)
    shares = (symbols / c, dup / k, repeat / w, min(chars / w, 40) / 40, upper / c, punct / c, digit / c, len(set(words)) / w ** 0.9, marked / w, min(n / k, 400) / 400, math.log1p(max(map(len, words), default=0)) / 8, raw.count(b"!") / w, raw.count(b"|") / w)
    return (n, chars, symbols, dup, repeat), shares


def base_failed(n_words, n_repeat):
    return (n_words < 10) | (100 * n_repeat > 20 * n_words)


def threshold(low: np.ndarray, high: np.ndarray, good: np.ndarray, bad: np.ndarray, lost: float = LOST) -> float:
    """The score above which rows are dropped; infinity without labelled rows of both kinds.

    Of each bin, in order: the least and the largest score, and its numbers of good and bad rows.
    """
    if not good.sum() or not bad.sum():
        return math.inf
    cost, gain = 1 - np.cumsum(good) / good.sum(), 1 - np.cumsum(bad) / bad.sum()
    gain[cost > lost] = -1
    i = int(np.argmax(gain - cost))
    return float(high[i] + (low[i + 1] if i + 1 < len(low) else high[i])) / 2


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [statistics(t or "") for t in b.column(1).to_pylist()]
        counts = np.array([c for c, _ in got], np.int64).reshape(-1, len(COUNTS))
        shares = np.array([s for _, s in got], float).reshape(len(got), SHARES)
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(counts[:, i]) for i in range(len(COUNTS))), pa.array(list(shares), pa.list_(pa.float64()))], ["doc_id", *COUNTS, "shares"])


def _scored(batches: Iterator[pa.RecordBatch], forest: Forest, limit: float) -> Iterator[pa.RecordBatch]:
    for b in batches:
        shares = b.column("shares").flatten().to_numpy().reshape(b.num_rows, SHARES)
        failed = base_failed(b.column("n_words").to_numpy(), b.column("n_repeat_words").to_numpy())
        score = forest.score(shares) if b.num_rows else np.empty(0)
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", *COUNTS)), pa.array(failed), pa.array(~failed & (score <= limit)), pa.array(score)], ["doc_id", *COUNTS, "base_failed", "kept", "anomaly"])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def measure(docs: DataFrame) -> DataFrame:
    """Rows ``doc_id``, base counts and ``shares`` of all documents, kept in the shared folder: texts are read once."""
    small_batches(docs.sparkSession)
    return cut(_texts(docs).mapInArrow(_measured, f"{MEASURES}, shares array<double>"))


def score(rows: DataFrame, forest: Forest, limit: float) -> DataFrame:
    return rows.mapInArrow(partial(_scored, forest=forest, limit=limit), f"{MEASURES}, base_failed boolean, kept boolean, anomaly double")


def fit(rows: DataFrame, labels: DataFrame, sample: int = SAMPLE, lost: float = LOST) -> tuple[Forest, float]:
    """Forest from about ``sample`` of the measured rows with a word, and the threshold from all with a label (``quality`` 0 or 1)."""
    part = min(1.0, sample / max(1, rows.count()))
    got = rows.where(share(F.col("doc_id"), 11) < part).orderBy("doc_id", *COUNTS).select("n_words", "n_repeat_words", "shares").collect()
    x = np.array([r["shares"] for r in got], float).reshape(len(got), SHARES)
    use = np.array([not base_failed(r["n_words"], r["n_repeat_words"]) for r in got], bool)
    forest = Forest(x[use], TREES, DRAWN, seed=3)
    known = labels.where("quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    judged = score(rows.join(known.select("doc_id"), "doc_id", "left_semi"), forest, math.inf).where(~F.col("base_failed")).join(known, "doc_id")
    good = F.count(F.when(F.col("quality") == 1, 1))
    bins = judged.groupBy(F.floor(F.col("anomaly") * BINS).alias("bin")).agg(F.min("anomaly"), F.max("anomaly"), good, F.count("*") - good).orderBy("bin").collect()
    return forest, threshold(*np.array([r[1:] for r in bins], float).reshape(len(bins), 4).T, lost)


def judge(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per document: ``doc_id``, the base counts, ``base_failed``, ``kept`` and ``anomaly``.

    Null and empty texts have no words and fail the base rules. Without labels of both kinds no document is dropped by
    the forest. Of several labels of a doc_id the best counts; a null doc_id has none. Repeated rows stay repeated and
    other columns are ignored. An empty table gives an empty result.
    """
    rows = measure(docs)
    return score(rows, *fit(rows, labels, sample))
