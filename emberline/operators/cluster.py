"""Clusters: deterministic Lloyd, nearest centres, principal components, mixtures, micro-clusters."""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.operators.stats import DIGITS

#: Rounds at most; they end before when no centre moves.
ROUNDS = 20


def distance(columns: list[str], centre: list[float]) -> Column:
    return F.sqrt(sum(((F.col(c) - F.lit(float(x))) * (F.col(c) - F.lit(float(x))) for c, x in zip(columns, centre)), F.lit(0.0)))


def nearest(columns: list[str], centres: list[list[float]]) -> tuple[Column, Column]:
    """Distance to the nearest centre and its number; of equals the least number. Centres are literals."""
    far = [F.round(distance(columns, c), DIGITS) for c in centres]
    least = F.least(*far) if len(far) > 1 else far[0]
    return least, (F.array_position(F.array(*far), least) - 1).cast("int")


def lloyd(df: DataFrame, key: str, columns: list[str], k: int, rounds: int = ROUNDS) -> list[list[float]]:
    """Centres that don't depend on how rows are dealt out.

    The first is the row with the least key, each next one the row farthest from all before (of equals the least
    key); then rounds until no centre moves, in which an empty cluster keeps its centre. Only centres come to the driver.
    """
    row = F.struct(*columns)
    first = df.agg(F.min_by(row, key).alias("r")).first()["r"]
    if first is None:
        return []
    centres = [list(first)]
    while len(centres) < k:
        far, _ = nearest(columns, centres)
        centres.append(list(df.agg(F.min_by(row, F.struct(-far, key)).alias("r")).first()["r"]))
    for _ in range(rounds):
        _, at = nearest(columns, centres)
        means = df.groupBy(at.alias("c")).agg(*(F.round(F.mean(c), DIGITS).alias(c) for c in columns)).collect()
        before = list(centres)
        for m in means:
            centres[m["c"]] = [m[c] for c in columns]
        if centres == before:
            break
    return centres


def kmeans(df: DataFrame, key: str, columns: list[str], k: int, score: str, cluster: str, rounds: int = ROUNDS) -> DataFrame:
    centres = lloyd(df, key, columns, k, rounds)
    if not centres:
        return df.withColumns({score: F.lit(None).cast("double"), cluster: F.lit(None).cast("int")})
    far, at = nearest(columns, centres)
    return df.withColumns({score: far, cluster: at})


def components(df: DataFrame, columns: list[str], dims: int) -> np.ndarray:
    """Main axes of the population covariance; each axis' largest entry is positive. d * d numbers come to the driver."""
    d = len(columns)
    row = df.agg(*(F.round(F.covar_pop(columns[i], columns[j]), DIGITS) for i in range(d) for j in range(i, d))).first()
    c = np.zeros((d, d))
    c[np.triu_indices(d)] = [x or 0.0 for x in row]
    values, axes = np.linalg.eigh(c + np.triu(c, 1).T)
    axes = axes[:, ::-1][:, :dims].T
    return np.round(axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])[:, None], DIGITS)


def project(df: DataFrame, columns: list[str], axes: np.ndarray, prefix: str = "pc") -> DataFrame:
    return df.withColumns({f"{prefix}{i}": F.round(sum((F.col(c) * F.lit(float(x)) for c, x in zip(columns, a)), F.lit(0.0)), DIGITS) for i, a in enumerate(axes)})


def mixture(df: DataFrame, columns: list[str] | str, k: int, cluster: str, seed: int = 42) -> DataFrame:
    """Full-covariance Gaussian mixture; adds the cluster and ``probability``, an array. A column name is an array column."""
    vector = array_to_vector(F.col(columns) if isinstance(columns, str) else F.array(*columns))
    model = GaussianMixture(featuresCol="_v", predictionCol=cluster, probabilityCol="_p", k=k, seed=seed)
    rows = df.withColumn("_v", vector)
    return model.fit(rows).transform(rows).withColumn("probability", vector_to_array("_p")).drop("_v", "_p")


def energy(probability: Column) -> Column:
    """-ln of the largest membership."""
    return -F.log(F.array_max(probability) + F.lit(1e-12))


def micro_clusters(df: DataFrame, cluster: str, flag: str, size: int = 1) -> DataFrame:
    """1 where the row's cluster has exactly ``size`` rows."""
    n = F.count("*").over(Window.partitionBy(cluster))
    return df.withColumn(flag, F.when(n == size, 1).otherwise(0))
