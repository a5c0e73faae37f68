"""Statistics in one pass, scaling, thresholds and flags."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.spec import FeatureSpec

#: Digits that statistics are rounded to before they are compared, so that the order of sums can't flip a flag.
DIGITS = 9
GRID = [round(2.0 + i / 10, 1) for i in range(21)]


def moments(df: DataFrame, columns: list[str]) -> dict[str, dict[str, float]]:
    """Mean, population and sample deviation of several columns in one job; one row comes to the driver."""
    kinds = {"mean": F.mean, "pop": F.stddev_pop, "samp": F.stddev_samp}
    row = df.agg(*(F.round(f(c), DIGITS).alias(f"{k}_{c}") for c in columns for k, f in kinds.items())).first()
    return {c: {k: row[f"{k}_{c}"] for k in kinds} for c in columns}


def feature_stats(df: DataFrame, spec: FeatureSpec) -> DataFrame:
    """One row per feature."""
    one = df.agg(*(x for c in spec.features for x in (F.count(c).alias(f"{c}_n"), F.round(F.mean(c), 6).alias(f"{c}_mean"), F.round(F.stddev_pop(c), 6).alias(f"{c}_std"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"))))
    rows = [F.struct(F.lit(c).alias("feature"), *(F.col(f"{c}_{k}").alias(k if k != "n" else "n_rows") for k in ("n", "mean", "std", "min", "max"))) for c in spec.features]
    return one.select(F.explode(F.array(*rows)).alias("s")).select("s.*")


def standardise(df: DataFrame, spec: FeatureSpec, centre: bool = True) -> DataFrame:
    """Adds z columns by the sample deviation; a constant column gives 0, a null stays null."""
    m = moments(df, list(spec.features))
    if any(v["mean"] is None for v in m.values()):
        return df.withColumns({z: F.lit(None).cast("double") for z in spec.z})
    z = {}
    for c, name in zip(spec.features, spec.z):
        s = m[c]["samp"]
        shifted = F.col(c) - F.lit(m[c]["mean"]) if centre else F.col(c)
        z[name] = shifted / F.lit(s) if s else F.when(F.col(c).isNotNull(), F.lit(0.0))
    return df.withColumns(z)


def threshold(df: DataFrame, score: str, n_std: float) -> float | None:
    """Mean plus n population deviations of the score; None without a score."""
    m = moments(df, [score])[score]
    return None if m["mean"] is None else m["mean"] + n_std * m["pop"]


def above(df: DataFrame, score: str, flag: str, n_std: float) -> DataFrame:
    """1 where the score is strictly above the threshold, null where it is null."""
    t = threshold(df, score, n_std)
    return df.withColumn(flag, F.lit(None).cast("int") if t is None else (F.col(score) > F.lit(t)).cast("int"))


def above_or_zero(df: DataFrame, score: str, flag: str, n_std: float) -> DataFrame:
    """As :func:`above`, but 0 where the score is null."""
    t = threshold(df, score, n_std)
    return df.withColumn(flag, F.lit(0) if t is None else F.when(F.col(score) > F.lit(t), 1).otherwise(0))


def minority(df: DataFrame, cluster: str) -> int | None:
    """The cluster with least rows; of several the least id."""
    sizes = df.where(F.col(cluster).isNotNull()).groupBy(cluster).count()
    row = sizes.agg(F.min(F.struct("count", F.col(cluster).alias("c")))["c"].alias("c")).first()
    return row["c"]


def in_minority(df: DataFrame, cluster: str, flag: str) -> DataFrame:
    m = minority(df, cluster)
    return df.withColumn(flag, F.lit(None).cast("int") if m is None else (F.col(cluster) == F.lit(m)).cast("int"))


def abs_z(df: DataFrame, spec: FeatureSpec, floor: float = 1e-10) -> list[Column]:
    """Distances from the mean in population deviations, none of them less than ``floor``."""
    m = moments(df, list(spec.features))
    return [F.abs((F.col(c) - F.lit(m[c]["mean"])) / F.lit(max(m[c]["pop"] or 0.0, floor))) for c in spec.features]


def static_z(df: DataFrame, spec: FeatureSpec, limit: float = 3.0, flag: str = "static_flag") -> DataFrame:
    """1 if any feature is more than ``limit`` deviations away."""
    return df.withColumn(flag, reduce(or_, (z > F.lit(limit) for z in abs_z(df, spec))).cast("int"))


def threshold_grid(df: DataFrame, spec: FeatureSpec) -> DataFrame:
    """``(threshold, n_above, n_rows)``: rows whose largest distance is above each grid value, in one pass."""
    far = df.select(F.greatest(*abs_z(df, spec)).alias("m"))
    one = far.agg(F.count("*").alias("n_rows"), *(F.sum((F.col("m") > F.lit(t)).cast("long")).alias(f"c{i}") for i, t in enumerate(GRID)))
    rows = F.array(*(F.struct(F.lit(t).alias("threshold"), F.coalesce(F.col(f"c{i}"), F.lit(0)).alias("n_above"), F.col("n_rows")) for i, t in enumerate(GRID)))
    return one.select(F.explode(rows).alias("g")).select("g.*")


def adaptive_threshold(df: DataFrame, spec: FeatureSpec, target: float) -> float:
    """The grid value whose share of rows is nearest to the target; of several the least."""
    distance = F.round(F.abs(F.col("n_above") / F.col("n_rows") - F.lit(target)), DIGITS)
    return threshold_grid(df, spec).agg(F.min(F.struct(distance.alias("d"), "threshold"))["threshold"].alias("t")).first()["t"]


def adaptive(df: DataFrame, spec: FeatureSpec, target: float, flag: str = "adaptive_flag") -> DataFrame:
    if df.isEmpty():
        return df.withColumn(flag, F.lit(None).cast("int"))
    return static_z(df, spec, adaptive_threshold(df, spec, target), flag)


def clamped_deviation(column: str, least: float = 1e-12) -> Column:
    """Population deviation of which the variance is at least ``least``."""
    return F.sqrt(F.greatest(F.var_pop(column), F.lit(least)))


def covariances(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(i, j, covariance)`` of the population for i <= j, in one pass."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    one = df.agg(*(F.covar_pop(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs))
    rows = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.round(f"c{i}_{j}", 6).alias("covariance")) for i, j in pairs))
    return one.select(F.explode(rows).alias("c")).select("c.*")
