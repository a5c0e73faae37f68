"""Models fitted in each partition, and one model made of them.

Rows are dealt out by a hash of the key, so the same rows give the same models wherever they run. A partition's model
has a size that parameters bound, whatever its rows; only models come to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.functions.forest import Forest
from emberline.operators.cluster import ROUNDS
from emberline.operators.sequence import row_shards
from emberline.operators.stats import DIGITS
from emberline.session import workers_find_package

#: Rows of a partition in which a model is fitted, about.
ROWS = 100_000


def dealt(df: DataFrame, key: str, parts: int | None = None) -> DataFrame:
    """Rows in partitions of about equal numbers, with ``_shard``; a partition holds whole shards, mostly one."""
    parts = parts or max(1, -(-df.count() // ROWS))
    return row_shards(df, key, parts).repartition(parts, "_shard")


def spread(df: DataFrame, parts: int) -> DataFrame:
    """Rows dealt out in turn, which evens out partitions of any skew; which row goes where isn't defined."""
    return df.repartition(parts)


def fit_parts(df: DataFrame, key: str, columns: list[str], fit: Callable[[np.ndarray], list[list[float]]], parts: int | None = None) -> list[tuple[int, list[float]]]:
    """``(shard, numbers)`` for each row of each shard's model, in the order of the shards; shards without rows have none."""
    workers_find_package(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(batches)
        if held:
            for shard, rows in pd.concat(held).groupby("_shard"):
                model = fit(rows.sort_values(key)[columns].to_numpy(float))
                yield pd.DataFrame({"shard": shard, "n": range(len(model)), "x": [list(map(float, m)) for m in model]})

    models = dealt(df.select(key, *columns), key, parts).mapInPandas(run, "shard int, n int, x array<double>")
    return [(s, x) for s, _, x in sorted((r["shard"], r["n"], r["x"]) for r in models.collect())]


#: Digits of merged centres: the mean of a few rounded numbers often ends in a five, which digits as few would round.
MERGED_DIGITS = 12


def lloyd_rows(x: np.ndarray, k: int, rounds: int = ROUNDS, digits: int = DIGITS) -> np.ndarray:
    """Centres of rows in memory by the rule of :func:`cluster.lloyd`; at most as many as there are rows."""
    if not len(x):
        return np.empty((0, x.shape[1]))
    centres = x[:1]
    while len(centres) < min(k, len(x)):
        centres = np.vstack([centres, x[_distances(x, centres).min(axis=1).argmax()]])
    for _ in range(rounds):
        at = _distances(x, centres).argmin(axis=1)
        moved = np.array([np.round(x[at == j].mean(axis=0), digits) if (at == j).any() else c for j, c in enumerate(centres)])
        if (moved == centres).all():
            break
        centres = moved
    return centres


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.round(np.stack([np.sqrt(((x - c) ** 2).sum(axis=1)) for c in centres], axis=1), DIGITS)


def merged_centres(df: DataFrame, key: str, columns: list[str], k: int, local_k: int | None = None, parts: int | None = None) -> list[list[float]]:
    """Lloyd in each shard, then over the shards' centres; nothing for an empty table."""
    found = fit_parts(df, key, columns, lambda x: lloyd_rows(x, local_k or k).tolist(), parts)
    return lloyd_rows(np.array([x for _, x in found]).reshape(-1, len(columns)), k, digits=MERGED_DIGITS).tolist()


def hard_mixture(x: np.ndarray, k: int, rounds: int = 10, ridge: float = 1e-6, start: float = 0.1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, covariances and weights where each row belongs to its likeliest component alone.

    A component without rows stays as it is; one with a single row keeps its covariance.
    """
    means = lloyd_rows(x, k)
    k, d = means.shape
    covariances, weights = np.tile(np.eye(d) * start, (k, 1, 1)), np.full(k, 1 / max(1, k))
    for _ in range(rounds if k else 0):
        at, before = likeliest(x, means, covariances, weights), means.copy()
        for j in np.unique(at):
            rows = x[at == j]
            means[j], weights[j] = rows.mean(axis=0), len(rows) / len(x)
            if len(rows) > 1:
                covariances[j] = np.cov(rows, rowvar=False).reshape(d, d) + ridge * np.eye(d)
        if np.allclose(before, means, rtol=1e-4):
            break
    return means, covariances, weights


def likeliest(x: np.ndarray, means: np.ndarray, covariances: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Each row's component of the greatest weighted density; of equals the first."""
    density = []
    for m, c, w in zip(means, covariances, weights):
        low = np.linalg.cholesky(c)
        far = np.linalg.solve(low, (x - m).T)
        density.append(np.log(w) - np.log(np.diag(low)).sum() - 0.5 * (far * far).sum(axis=0))
    return np.argmax(density, axis=0)


def hard_mixture_labels(df: DataFrame, key: str, columns: list[str], k: int, name: str, parts: int | None = None) -> DataFrame:
    """Adds each row's component in the mixture of its own shard, and ``_shard``. Components of two shards don't correspond."""
    workers_find_package(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(batches)
        if held:
            for _, rows in pd.concat(held).groupby("_shard"):
                rows = rows.sort_values(key)
                x = rows[columns].to_numpy(float)
                yield rows.assign(**{name: likeliest(x, *hard_mixture(x, k))})

    rows = dealt(df, key, parts)
    return rows.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", `{name}` int")


def forests(df: DataFrame, key: str, columns: list[str], trees: int = 50, drawn: int = 256, parts: int | None = None, seed: int = 42) -> list[Forest]:
    """One forest of each shard, from all of its rows. ``trees`` is for all forests together, at least one each."""
    parts = parts or max(1, -(-df.count() // ROWS))
    each = max(1, trees // parts)

    def fit(x: np.ndarray) -> list[list[float]]:
        f = Forest(x, each, drawn, seed)
        return [f.feature, f.split, f.left, f.length, f.roots, [f.drawn, f.depth]]

    found = fit_parts(df, key, columns, fit, parts)
    out = []
    for i in range(0, len(found), 6):
        f = object.__new__(Forest)
        f.feature, f.split, f.left, f.length, f.roots = (np.array(x) for _, x in found[i : i + 5])
        f.feature, f.left, f.roots = f.feature.astype(int), f.left.astype(int), f.roots.astype(int)
        f.drawn, f.depth = map(int, found[i + 5][1])
        out.append(f)
    return out


def forest_mean(df: DataFrame, columns: list[str], grown: list[Forest], name: str) -> DataFrame:
    """Adds the mean of the forests' scores; 0.5 without a forest."""
    workers_find_package(df.sparkSession)

    @F.pandas_udf("double")
    def scored(*cols: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(float) for c in cols])
        return pd.Series(np.mean([f.score(x) for f in grown], axis=0) if grown else np.full(len(x), 0.5))

    return df.withColumn(name, scored(*columns))
