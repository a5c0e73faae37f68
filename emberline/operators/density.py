"""Density noise and neighbours' distances: exact, over all rows, without comparing all pairs.

Distinct points are dealt by quantiles of the columns into regions of about ``REGION`` points. A region's task holds its
points in blocks and compares only blocks that are near enough, so each point gets the distance of its k-th neighbour
within the region. That is final where no face of the region is nearer; the other points that matter are sent to the
regions around. A point stands for all rows that are equal to it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.hashing import draw
from emberline.session import workers_find_package

#: Distinct points of a region, about, and points of a block.
REGION, BLOCK = 16_384, 64
#: Steps of a histogram in which a distance doubles twice (its square once).
STEPS = 200
#: The step of squared distances of zero.
ZERO = -1_000_000


def kth_distances(x: np.ndarray, k: int) -> np.ndarray:
    """Distance of each row to its k-th nearest one, itself included, by all pairs."""
    k = min(k, len(x))
    out = np.empty(len(x))
    for i in range(0, len(x), 512):
        d = ((x[i : i + 512, None, :] - x[None]) ** 2).sum(axis=2)
        out[i : i + 512] = np.sqrt(np.partition(d, k - 1, axis=1)[:, k - 1])
    return out


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all pairs, added in the columns' order."""
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        t = a[:, j, None] - b[None, :, j]
        t *= t
        out += t
    return out


def _gaps(lo: np.ndarray, hi: np.ndarray, los: np.ndarray, his: np.ndarray) -> np.ndarray:
    """Squared distances of boxes; never over that of two points in them, rounding included."""
    out = np.zeros((len(lo), len(los)))
    for j in range(lo.shape[1]):
        t = np.maximum(np.maximum(los[None, :, j] - hi[:, j, None], lo[:, j, None] - his[None, :, j]), 0.0)
        out += t * t
    return out


def _nearest(of: np.ndarray, far: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each query's hits the nearest, up to k rows of them (of, far, weight), and whether a hit is the k-th row."""
    at = np.lexsort((far, of))
    of, far, weight = of[at], far[at], weight[at]
    total = np.cumsum(weight)
    first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.empty(0, int)
    before = np.repeat((total - weight)[first], np.diff(np.r_[first, len(of)]))
    have = total - before
    keep = have - weight < k
    return of[keep], far[keep], weight[keep], (have >= k)[keep]


def blocks(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the points in which blocks of near ones are together, and the blocks' starts."""
    order, starts, stack = np.arange(len(x)), [], [(0, len(x))] if len(x) else []
    while stack:
        i, j = stack.pop()
        if j - i <= BLOCK:
            starts.append(i)
            continue
        part = order[i:j]
        axis = np.ptp(x[part], axis=0).argmax()
        half = (j - i) // 2
        order[i:j] = part[np.argpartition(x[part, axis], half)]
        stack += [(i, i + half), (i + half, j)]
    return order, np.sort(np.array(starts, int))


class Region:
    """The points of one region, in blocks."""

    def __init__(self, x: np.ndarray, weight: np.ndarray):
        order, self.starts = blocks(x)
        self.order, self.x, self.weight = order, x[order], weight[order]
        self.ends = np.r_[self.starts[1:], len(x)].astype(int)
        self.lo, self.hi = self._boxes(self.x, self.starts)

    @staticmethod
    def _boxes(x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(x):
            return x, x
        return np.minimum.reduceat(x, starts, axis=0), np.maximum.reduceat(x, starts, axis=0)

    def _in(self, some: np.ndarray) -> np.ndarray:
        """Numbers of the points of some blocks."""
        n = self.ends[some] - self.starts[some]
        return np.repeat(self.starts[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())

    def hits(self, x: np.ndarray, limit: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, ...]]:
        """For queries and their squared limits the nearest points: (query, squared distance, weight, is the k-th row)."""
        order, starts = blocks(x)
        los, his = self._boxes(x[order], starts)
        for i, j, lo, hi in zip(starts, np.r_[starts[1:], len(x)].astype(int), los, his):
            q = order[i:j]
            gap = _gaps(lo[None], hi[None], self.lo, self.hi)[0]
            bound = limit[q]
            near = np.argsort(gap, kind="stable")[:4]
            if len(gap) > 4 and np.isfinite(gap).any():  # a tighter limit from the nearest blocks
                at = self._in(np.sort(near))
                of, far, _, kth = self._met(x[q], at, bound, k)
                bound = bound.copy()
                bound[of[kth]] = np.minimum(bound[of[kth]], far[kth])
            at = self._in(np.flatnonzero(gap <= bound.max()))
            if len(at):
                of, far, weight, kth = self._met(x[q], at, bound, k)
                yield q[of], far, weight, kth

    def _met(self, x: np.ndarray, at: np.ndarray, limit: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
        far = _squares(x, self.x[at])
        of, hit = np.nonzero(far <= limit[:, None])
        return _nearest(of, far[of, hit], self.weight[at[hit]], k)

    def kth(self, k: int) -> np.ndarray:
        """Squared distance of each point to its k-th row within the region, in the order of :attr:`x`; infinite where there are fewer."""
        out = np.full(len(self.x), np.inf)
        for of, far, _, kth in self.hits(self.x, np.full(len(self.x), np.inf), k):
            out[of[kth]] = far[kth]
        return out


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))


def _own(batches: Iterator[pa.RecordBatch], k: int, lo: np.ndarray, hi: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(region, x, weight) of one region -> also a number, and the squared distances of the k-th row within it and of its nearest face."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    at, d = got[0].column(0)[0].as_py(), lo.shape[1]
    here = Region(np.concatenate([_matrix(b.column(1), d) for b in got]), np.concatenate([b.column(2).to_numpy() for b in got]))
    face = np.minimum(here.x - lo[at], hi[at] - here.x).min(axis=1) ** 2
    columns = [np.full(len(face), at, np.int32), (at << 40) + np.arange(len(face)), None, here.weight, here.kth(k), face]
    whole = pa.RecordBatch.from_arrays([_lists(here.x) if c is None else pa.array(c) for c in columns], ["region", "number", "x", "weight", "kth", "face"])
    for i in range(0, len(face), 8192):
        yield whole.slice(i, 8192)


def _sent(batches: Iterator[pa.RecordBatch], lo: np.ndarray, hi: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(number, x, limit) -> (region, asks, number, x, limit) for each region within the limit."""
    for b in batches:
        x, limit = _matrix(b.column(1), lo.shape[1]), b.column(2).to_numpy()
        for i in range(0, len(x), 1024):
            at, there = np.nonzero(_gaps(x[i : i + 1024], x[i : i + 1024], lo, hi) <= limit[i : i + 1024, None])
            at += i
            yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(np.ones(len(at), bool)), b.column(0).take(pa.array(at)), _lists(x[at]), pa.array(limit[at])], ["region", "asks", "number", "x", "value"])


def _answers(batches: Iterator[pa.RecordBatch], k: int, d: int) -> Iterator[pa.RecordBatch]:
    """Points (value: weight), then queries (value: limit) of one region -> (number, far, weight) of each query's nearest points."""
    points, here = [], None
    for b in batches:
        asks = b.column(1).to_numpy(zero_copy_only=False)
        for part, asked in ((b.filter(pa.array(~asks)), False), (b.filter(pa.array(asks)), True)):
            if not part.num_rows:
                continue
            x, value = _matrix(part.column(3), d), part.column(4).to_numpy()
            if not asked:
                points.append((x, value))
                continue
            if not points:
                return
            here = here or Region(*(np.concatenate(c) for c in zip(*points)))
            number = part.column(2).to_numpy()
            for of, far, weight, _ in here.hits(x, value, k):
                yield pa.RecordBatch.from_arrays([pa.array(number[of]), pa.array(far), pa.array(weight.astype(np.int64))], ["number", "far", "weight"])


def _merged(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """All (number, far, weight) of some queries -> (number, kth) of those that have k rows."""
    got = [b for b in batches if b.num_rows]
    if got:
        of, far, _, kth = _nearest(*(np.concatenate([b.column(i).to_numpy() for b in got]) for i in range(3)), k)
        yield pa.RecordBatch.from_arrays([pa.array(of[kth]), pa.array(far[kth])], ["number", "kth"])


@dataclass
class Field:
    """Distinct points by region (region, number, x, weight, kth, face) and the regions' bounds."""

    points: DataFrame
    columns: list[str]
    k: int
    lo: np.ndarray
    hi: np.ndarray

    def asked(self, queries: DataFrame, of: DataFrame, k: int) -> DataFrame:
        """Queries (number, x, limit) -> (number, kth): squared distance of the k-th row of ``of``, where it is within the squared limit."""
        d = len(self.columns)
        sent = queries.select("number", "x", "limit").mapInArrow(partial(_sent, lo=self.lo, hi=self.hi), "region int, asks boolean, number long, x array<double>, value double")
        rows = of.select("region", F.lit(False).alias("asks"), "number", "x", F.col("weight").cast("double").alias("value")).unionByName(sent)
        rows = rows.repartitionById(len(self.lo), F.col("region")).sortWithinPartitions("asks")
        found = rows.mapInArrow(partial(_answers, k=k, d=d), "number long, far double, weight long")
        return found.repartition("number").mapInArrow(partial(_merged, k=k), "number long, kth double")


def _finite(columns: list[str]) -> Column:
    whole = F.lit(True)
    for c in columns:
        whole = whole & F.col(c).isNotNull() & (F.abs(F.col(c)) < F.lit(math.inf))
    return whole


def _regions(points: DataFrame, columns: list[str], parts: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Adds ``region`` by quantiles of one column after the other within what there is so far; wide columns are cut most."""
    d = len(columns)
    points, boxes = points.withColumn("region", F.lit(0)), [([-math.inf] * d, [math.inf] * d)]
    each_of = [1] * d
    if parts > 1:
        ends = points.agg(*(F.percentile_approx(c, [0.05, 0.95], 1000).alias(c) for c in columns)).first()
        wide = np.array([ends[c][1] - ends[c][0] for c in columns])
        while math.prod(each_of) < parts:
            each_of[int((wide / each_of).argmax())] += 1
    for j, each in enumerate(each_of):
        if each < 2:
            continue
        cuts = F.percentile_approx(columns[j], [i / each for i in range(1, each)], 1000)
        edges = {r["region"]: sorted(set(r["cuts"])) for r in points.groupBy("region").agg(cuts.alias("cuts")).collect()}
        edges = [edges.get(i, []) for i in range(len(boxes))]
        first = np.cumsum([0, *(len(e) + 1 for e in edges)])[:-1]
        literal = F.array(*(F.array(*(F.lit(float(x)) for x in e)).cast("array<double>") for e in edges))
        starts = F.array(*(F.lit(int(x)) for x in first))
        at = F.element_at(starts, F.col("region") + 1) + F.size(F.filter(F.element_at(literal, F.col("region") + 1), lambda e: e < F.col(columns[j])))
        points = points.withColumn("region", at.cast("int"))
        made = []
        for (lo, hi), e in zip(boxes, edges):
            for a, b in zip([lo[j], *e], [*e, hi[j]]):
                made.append(([*lo[:j], a, *lo[j + 1 :]], [*hi[:j], b, *hi[j + 1 :]]))
        boxes = made
    return points, np.array([b[0] for b in boxes]), np.array([b[1] for b in boxes])


def field(df: DataFrame, columns: list[str], k: int, size: int | None = None) -> Field:
    """The distinct points of all rows, with the distance of each one's k-th row in its region; itself counts."""
    workers_find_package(df.sparkSession)
    points = df.where(_finite(columns)).groupBy(*(F.col(c).cast("double").alias(c) for c in columns)).agg(F.count("*").alias("weight")).cache()
    dealt, lo, hi = _regions(points, columns, -(-points.count() // (size or REGION)))
    dealt = dealt.select("region", F.array(*columns).alias("x"), "weight").repartitionById(len(lo), F.col("region"))
    own = dealt.mapInArrow(partial(_own, k=k, lo=lo, hi=hi), "region int, number long, x array<double>, weight long, kth double, face double").cache()
    own.count()
    points.unpersist()
    return Field(own, columns, k, lo, hi)


def _step(c: Column) -> Column:
    return F.when(c > 0, F.floor(F.log2(c) * STEPS)).otherwise(ZERO).cast("int")


def _from_top(rows: DataFrame, c: Column, ranks: list[int]) -> list[int]:
    """The histogram's steps of the largest values of these ranks, weights counted."""
    found = rows.groupBy(_step(c).alias("step")).agg(F.sum("weight").alias("n")).collect()
    found.sort(key=lambda r: -r["step"])
    total = np.cumsum([r["n"] for r in found])
    return [found[int(np.searchsorted(total, n))]["step"] for n in ranks]


def percentile_of(f: Field, percentile: float) -> float:
    """Percentile (0 to 1, linear between two rows) of all rows' distances to their k-th row; 0 without rows.

    Distances are sought of those points alone that can be among the largest ones, down to the percentile's rank. Of a
    region's points at least so many are as far as the lesser of the face and the k-th row in the region.
    """
    n = f.points.agg(F.sum("weight")).first()[0] or 0
    if not n:
        return 0.0
    place = (n - 1) * percentile
    low = math.floor(place)
    ranks = [n - low, max(1, n - low - 1)]  # from the largest
    step = _from_top(f.points, F.least("kth", "face"), ranks[:1])[0]
    least = 0.0 if step == ZERO else 2.0 ** ((step - 1) / STEPS)
    rows = f.points.where(F.col("kth") >= least)
    open_ = F.col("kth") > F.col("face")
    asked = f.asked(rows.where(open_).select("number", "x", F.col("kth").alias("limit")), f.points, f.k)
    exact = rows.where(~open_).select("kth", "weight").unionByName(rows.where(open_).select("number", "weight").join(asked, "number").select("kth", "weight")).cache()
    steps = _from_top(exact, F.col("kth"), ranks)
    above = exact.where(_step(F.col("kth")) > max(steps)).agg(F.sum("weight")).first()[0] or 0
    near = exact.where(_step(F.col("kth")).between(min(steps), max(steps))).groupBy("kth").agg(F.sum("weight").alias("n")).collect()
    exact.unpersist()
    near.sort(key=lambda r: -r["kth"])
    total = above + np.cumsum([r["n"] for r in near])
    a, b = (math.sqrt(near[int(np.searchsorted(total, r))]["kth"]) for r in ranks)
    return a + (place - low) * (b - a)


def estimate_eps(df: DataFrame, key: str, columns: list[str], k: int, percentile: float, sample: int | None = None, seed: int = 42) -> float:
    """Percentile of the distance to the k-th neighbour, over all rows; over as many as ``sample`` says where it is given."""
    rows = df if sample is None else df.orderBy(draw(f"eps{seed}", F.col(key)), key).limit(sample)
    return _eps(rows, columns, k, percentile)[0]


def _eps(df: DataFrame, columns: list[str], k: int, percentile: float) -> tuple[float, Field]:
    n = df.where(_finite(columns)).count()
    f = field(df, columns, min(k, max(1, n)))
    return round(percentile_of(f, percentile), 6), f


def noise(df: DataFrame, key: str, columns: list[str], eps: float, min_rows: int, flag: str, made: Field | None = None) -> DataFrame:
    """1 where no core row lies within ``eps``; a core row has ``min_rows`` rows, itself included, within ``eps``.

    ``made`` is the field of the same rows and ``k = min_rows``, where it is there already.
    """
    if eps <= 0:
        return df.withColumn(flag, F.lit(0))
    f = made if made is not None and made.k == min_rows else field(df, columns, min_rows)
    limit = F.lit(float(eps * eps))
    found = f.asked(f.points.where((F.col("kth") > limit) & (F.col("face") <= limit)).select("number", "x", limit.alias("limit")), f.points, min_rows)
    points = f.points.join(found.select("number", F.lit(True).alias("found")), "number", "left")
    points = points.withColumn("core", (F.col("kth") <= limit) | F.col("found").isNotNull()).cache()
    lonely = points.where(~F.col("core"))
    reached = f.asked(lonely.select("number", "x", limit.alias("limit")), points.where("core"), 1)
    out = lonely.join(reached.select("number"), "number", "left_anti").select(*(F.col("x")[i].alias(f"_x{i}") for i in range(len(columns))), F.lit(1).alias("_noise"))
    same = F.lit(True)
    for i, c in enumerate(columns):
        same = same & (F.col(c).cast("double") == F.col(f"_x{i}"))
    flagged = df.join(out, same, "left").withColumn(flag, F.when(F.col("_noise").isNotNull() | ~_finite(columns), 1).otherwise(0))
    return flagged.drop("_noise", *(f"_x{i}" for i in range(len(columns))))


def eps_and_noise(df: DataFrame, key: str, columns: list[str], k: int, percentile: float, flag: str) -> DataFrame:
    """:func:`noise` at :func:`estimate_eps` of all rows, whose points are dealt out once."""
    eps, f = _eps(df, columns, k, percentile)
    return noise(df, key, columns, eps, k, flag, f)
