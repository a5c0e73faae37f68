"""Toxicity by weak supervision.

1. Voters. Words and word beginnings that mark toxic rows of a bounded labelled sample become lexicon voters, picked one
   after another by the rows they add; pattern voters look at how the hits are spread over the text.
2. Label model. A generative model of the votes alone: the hidden label, and each voter's chance of each vote given the
   label and the vote of the one voter that it is most correlated with (a tree; conditional mutual information finds
   it). Expectation maximisation estimates these accuracies and correlations. The given labels don't vote: they set the
   share of toxic rows and calibrate the posterior's log odds by two numbers.
3. A linear classifier is trained on the posterior labels, and scores every whole text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import partial

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import share, small_batches

#: Labelled documents that voters, label model and classifier are fitted on, about.
SAMPLE = 10_000
#: Lexicon voters at most, and candidates they are picked from: parameters of :func:`fit`.
VOTERS, CANDIDATES = 256, 6000
#: Evidence (twice the log likelihood, 8 degrees of freedom) from which two voters count as correlated.
EVIDENCE = 20.0
WORD = re.compile(r"[^\W\d_]+")
#: Features of the pattern voters.
PATTERNS = 4
#: Lengths of word beginnings, and hits from which a term counts as frequent in a text.
HEADS = (3, 4, 5, 6, 7)
OFTEN = 2


def terms(text: str) -> set[str]:
    """Words of the lower-case text and, as ``head~``, their beginnings; with ``#`` after them, those hit often."""
    words = Counter(WORD.findall(text.lower()))
    heads: Counter = Counter()
    for w, k in words.items():
        for n in HEADS:
            if len(w) > n:
                heads[w[:n] + "~"] += k
    return {t + o for found in (words, heads) for t, k in found.items() for o in (("", "#") if k >= OFTEN else ("",))}


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic) -> (term, toxic rows, clean rows), summed over the task; terms of clean rows alone aren't sent."""
    count: tuple[Counter, Counter] = (Counter(), Counter())
    for b in batches:
        for text, toxic in zip(*(c.to_pylist() for c in b.columns)):
            count[toxic].update(terms(text))
    both = [(t, n, 0) for t, n in count[1].items()] + [(t, 0, n) for t, n in count[0].items()]
    for i in range(0, len(both), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*both[i : i + 50_000]), (pa.string(), pa.int64(), pa.int64()))], ["term", "toxic", "clean"])


class Matcher:
    """Finds lexicon terms in lower-case text: whole words, and ``head~`` at the start of longer words."""

    def __init__(self, lexicon: list[str]):
        self.lexicon, self.heads, self.often = lexicon, ["~" in t for t in lexicon], np.array(["#" in t for t in lexicon], bool)
        self.size = [len(t.rstrip("~#")) for t in lexicon]
        self.find = ahocorasick.Automaton()
        for i, t in enumerate(lexicon):
            bare = t.rstrip("~#")
            self.find.add_word(bare, (*self.find.get(bare, ()), i))
        if lexicon:
            self.find.make_automaton()

    def __reduce__(self):
        return Matcher, (self.lexicon,)

    def hits(self, text: str) -> list[tuple[int, int]]:
        """(place, term number) of each hit."""
        if not self.lexicon:
            return []
        low, out = text.lower(), []
        for end, found in self.find.iter(low):
            for i in found:
                start = end + 1 - self.size[i]
                if start and low[start - 1].isalpha() or self.heads[i] != (end + 1 < len(low) and low[end + 1].isalpha()):
                    continue
                out.append((start, i))
        return out

    def features(self, text: str) -> np.ndarray:
        """Presence of each term, then number, density, variety and spread of the places hit."""
        hits = self.hits(text)
        m = len(self.lexicon)
        x = np.zeros(m + PATTERNS)
        if hits:
            count = np.bincount([i for _, i in hits], minlength=m)
            x[:m] = count >= np.where(self.often, OFTEN, 1)
            places = {p for p, i in hits if x[i]}
            if places:
                n_words = max(1, len(text) // 6)
                x[m:] = np.log1p(len(places)), min(1.0, 20 * len(places) / n_words), np.log1p(x[:m].sum()), (max(places) - min(places)) / max(1, len(text))
        return x


def votes(x: np.ndarray) -> np.ndarray:
    """Features -> votes 1 (toxic), -1 (clean), 0 (none): the lexicon's, then the patterns'."""
    lex, n, density, variety, spread = x[:, :-PATTERNS], *x[:, -PATTERNS:].T
    patterns = (np.where(n > np.log(2.5), 1, np.where(n == 0, -1, 0)), np.where(density > 0.3, 1, np.where(density == 0, -1, 0)), np.where(variety > np.log(2.5), 1, 0), np.where(spread > 0.5, 1, 0))
    return np.column_stack([lex.astype(np.int8), *(p.astype(np.int8) for p in patterns)])


class LabelModel:
    """Votes -1, 0, 1 of voters given a hidden label; estimated from the votes alone.

    ``up``: of each voter the voter that its vote depends on, or -1. ``share``: prior of the label.
    """

    def __init__(self, v: np.ndarray, share: float, rounds: int = 60):
        self.share, self.m = share, v.shape[1]
        self.up = np.full(self.m, -1)
        total = v.sum(axis=1)
        self.posterior = np.where(total > 0, 0.9, np.where(total < 0, 0.02, share))
        shown = (v[:, :, None] == np.array([-1, 0, 1])).reshape(len(v), -1).astype(float)
        self._estimate(v, shown, rounds)
        self.up = self._tree(shown)
        if (self.up >= 0).any():
            self._estimate(v, shown, rounds)

    def _joint(self, shown: np.ndarray) -> list[np.ndarray]:
        """For each label the soft counts of pairs of votes: [voter, vote, other voter, other vote]."""
        return [((shown.T * w) @ shown).reshape(self.m, 3, self.m, 3) for w in (self.posterior, 1 - self.posterior)]

    def _estimate(self, v: np.ndarray, shown: np.ndarray, rounds: int) -> None:
        every, root = np.arange(self.m), self.up < 0
        for _ in range(rounds):
            logs = []
            for joint in self._joint(shown):
                own = joint[every, :, every, :][:, range(3), range(3)] + 0.05 * np.array([1, 8, 1])  # most voters abstain
                own /= own.sum(axis=1, keepdims=True)
                chance = joint[self.up, :, every, :] + 2 * own[:, None, :]  # towards independence where votes are few
                chance = np.where(root[:, None, None], own[:, None, :], chance / chance.sum(axis=2, keepdims=True))
                logs.append(np.log(chance)[every, v[:, self.up] + 1, v + 1].sum(axis=1))
            self.odds = np.clip(logs[0] - logs[1] + np.log(self.share / (1 - self.share)), -30, 30)
            new = 1 / (1 + np.exp(-self.odds))
            moved = np.abs(new - self.posterior).max()
            self.posterior = new
            if moved < 1e-6:
                break

    def _tree(self, shown: np.ndarray) -> np.ndarray:
        """Maximum spanning tree of the conditional mutual information of pairs, without edges of little evidence."""
        info = np.zeros((self.m, self.m))
        for joint in self._joint(shown):
            j = joint.transpose(0, 2, 1, 3) + 1e-9
            info += (j * np.log(j * j.sum(axis=(2, 3), keepdims=True) / (j.sum(axis=3, keepdims=True) * j.sum(axis=2, keepdims=True)))).sum(axis=(2, 3))
        np.fill_diagonal(info, 0)
        up, best, near, open_ = np.full(self.m, -1), info[0].copy(), np.zeros(self.m, int), np.arange(self.m) > 0
        while open_.any():
            j = int(np.argmax(np.where(open_, best, -1)))
            open_[j] = False
            if 2 * best[j] > EVIDENCE:
                up[j] = near[j]
            near = np.where(info[j] > best, j, near)
            best = np.maximum(best, info[j])
        return up

    def calibrated(self, given: np.ndarray) -> np.ndarray:
        """The posterior with its log odds scaled and shifted so that they suit the given labels."""
        z = self.odds[:, None] / 10
        w = linear(z, given.astype(float))
        return 1 / (1 + np.exp(-np.clip(z @ w[:-1] + w[-1], -30, 30)))


def linear(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, rounds: int = 60) -> np.ndarray:
    """Weights and constant of a logistic regression on soft labels, by Newton steps."""
    z = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    ridge = np.full(len(w), penalty * len(z))
    ridge[-1] = 1e-9
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z.T * (p * (1 - p) + 1e-6)) @ z + np.diag(ridge + 1e-9), z.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def pick(candidates: list[str], rows: list[set[int]], toxic: np.ndarray, most: int, least: int = 2) -> list[str]:
    """Terms that one after another add most toxic rows not yet hit, for few clean ones."""
    has = np.zeros((len(rows), len(candidates)), bool)
    for i, r in enumerate(rows):
        has[i, list(r)] = True
    clean = has[~toxic].sum(axis=0)
    total = has[toxic].sum(axis=0)
    pure = total / (total + 3.0 * clean + 1.0)
    has, out = has[toxic], []
    while len(out) < min(most, len(candidates)) and len(has):
        gain = has.sum(axis=0) * (pure >= 0.6)
        best = int(np.argmax(gain * pure + 1e-6 * total))
        if gain[best] < least:
            break
        out.append(best)
        has = has[~has[:, best]]
    # terms that are as pure and nearly as frequent as the picked ones, so that rows have several voters
    bare = {candidates[i].rstrip("~#") for i in out}
    for i in np.argsort(-total * pure, kind="stable"):
        if len(out) >= most:
            break
        own = candidates[i].rstrip("~#")
        if pure[i] >= 0.9 and total[i] >= max(least, 0.02 * toxic.sum()) and not any(own.startswith(b) or b.startswith(own) for b in bare):
            out.append(int(i))
            bare.add(own)
    return [candidates[i] for i in out]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, voters: int = VOTERS, candidates: int = CANDIDATES) -> tuple[Matcher, np.ndarray]:
    """Learns from about ``sample`` labelled rows with crc32(doc_id) mod 5 not 0; equal texts count once.

    At most ``voters`` terms vote, picked from the ``candidates`` that mark toxic rows best.
    """
    small_batches(docs.sparkSession)
    chosen = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0) & F.col("doc_id").isNotNull()
    known = labels.where(chosen).where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    part = share(F.col("doc_id"), 5) < min(1.0, sample / max(1, known.count()))
    texts = docs.where(chosen & part).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = texts.join(known.where(part), "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic"), F.min("doc_id").alias("doc_id"))
    rows = rows.select("text", (F.col("toxic") == 1).alias("toxic"), "doc_id").cache()
    counts = rows.select("text", "toxic").mapInArrow(_term_counts, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where("toxic >= 2 and toxic > clean")
    order = F.col("toxic") * F.col("toxic") / (F.col("toxic") + 3 * F.col("clean") + 1)
    found = [r["term"] for r in counts.orderBy(order.desc(), F.length("term").desc(), "term").limit(candidates).select("term").collect()]
    number = {t: i for i, t in enumerate(found)}

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [[number[t] for t in terms(x) if t in number] for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.list_(pa.int32())), b.column(1), b.column(2)], ["terms", "toxic", "doc_id"])

    got = sorted((r["doc_id"], r["toxic"], r["terms"]) for r in rows.mapInArrow(held, "terms array<int>, toxic boolean, doc_id long").collect())
    toxic = np.array([r[1] for r in got], bool)
    matcher = Matcher(pick(found, [set(r[2]) for r in got], toxic, voters))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([matcher.features(x) for x in b.column(0).to_pylist()], pa.list_(pa.float64())), b.column(2)], ["x", "doc_id"])

    x = np.array([r["x"] for r in sorted(rows.mapInArrow(featured, "x array<double>, doc_id long").collect(), key=lambda r: r["doc_id"])], float).reshape(len(got), len(matcher.lexicon) + PATTERNS)
    rows.unpersist()
    if not toxic.any() or toxic.all():
        weights = np.zeros(len(matcher.lexicon) + PATTERNS + 1)
        weights[-1] = 4.0 if len(toxic) and toxic.all() else -4.0
        return matcher, weights
    return matcher, linear(x, LabelModel(votes(x), float(toxic.mean())).calibrated(toxic))


def _scores(batches: Iterator[pa.RecordBatch], model: tuple[Matcher, np.ndarray]) -> Iterator[pa.RecordBatch]:
    matcher, w = model
    for b in batches:
        z = np.array([matcher.features(t or "") @ w[:-1] + w[-1] for t in b.column("text").to_pylist()], float)
        score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        names = [n for n in b.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], [*names, "score", "predicted"])


def score(docs: DataFrame, model: tuple[Matcher, np.ndarray]) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``.

    Null and empty texts have no hit and get the score of a text without any. Of a text all hits count, however long
    it is. Equal texts have equal scores. ``held_out`` is true where crc32 of the
    doc_id mod 5 is 0 (false for a null id). Without labels of both kinds all rows get one score. Repeated rows stay
    repeated and other columns are ignored. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(partial(_scores, model=model), "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: tuple[Matcher, np.ndarray]) -> DataFrame:
    """The documents, all their columns, that aren't predicted toxic.

    Null and empty texts stay (unless the model rejects a text without any hit), repeated rows stay or go together.
    """
    small_batches(docs.sparkSession)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, w = model
        for b in batches:
            z = np.array([matcher.features(t or "") @ w[:-1] + w[-1] for t in b.column("text").to_pylist()], float)
            yield b.filter(pa.array(z < 0))

    return docs.mapInArrow(clean, docs.schema)
