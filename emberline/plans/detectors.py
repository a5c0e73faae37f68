"""The detectors by name, what each needs, and the whole ensemble."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.functions.forest import Forest
from emberline.functions.hashing import draw
from emberline.operators import cluster, density, ensemble, neural, sequence, stats
from emberline.session import workers_find_package
from emberline.spec import DEFAULT, FeatureSpec, Preset

#: Detectors of an ensemble that are made at once: most of their jobs are short.
TOGETHER = 6
#: Rows that isolation forests are grown from at most.
FOREST_ROWS = 20_000

#: Rows at most, about, that one task of a fit's round reads; of fewer, more than the slots would only cost tasks.
PART_ROWS = 100_000


@dataclass
class Inputs:
    """Rows with raw and z columns; what several detectors share is made once."""

    rows: DataFrame
    spec: FeatureSpec
    preset: Preset
    made: dict = None

    def __post_init__(self):
        self.made = self.made or {}

    def shared(self, name: str, make: Callable):
        if name not in self.made:
            self.made[name] = make()
        return self.made[name]

    @property
    def vectors(self) -> DataFrame:
        return self.rows.withColumn("x", F.array(*self.spec.z))

    @property
    def sequences(self) -> DataFrame:
        sharded = sequence.seq_shards(self.rows, self.spec.id, neural.task_count(self.rows.sparkSession), "_rn")
        return sequence.windows(sharded, self.spec.id, self.spec.z, self.preset.window, position="_rn").withColumnRenamed("window", "x")


def _kmeans(i: Inputs) -> DataFrame:
    return stats.above(cluster.kmeans(i.rows, i.spec.id, i.spec.z, i.preset.kmeans_k, "kmeans_distance", "kmeans_cluster"), "kmeans_distance", "kmeans_flag", i.preset.n_std["kmeans"])


def _gmm(i: Inputs) -> DataFrame:
    return stats.in_minority(cluster.mixture(i.rows, i.spec.z, i.preset.gmm_k, "gmm_cluster", i.preset.seed), "gmm_cluster", "gmm_flag")


def _pca(i: Inputs) -> DataFrame:
    axes = cluster.components(i.rows, i.spec.z, i.preset.pca_dims)
    rows = cluster.project(i.rows, i.spec.z, axes)
    return stats.in_minority(cluster.kmeans(rows, i.spec.id, [f"pc{j}" for j in range(len(axes))], i.preset.pca_k, "pca_distance", "pca_cluster"), "pca_cluster", "pca_kmeans_flag")


def _dbscan(i: Inputs) -> DataFrame:
    k = i.preset.dbscan_k_per_feature * len(i.spec.features)
    return density.eps_and_noise(i.rows, i.spec.id, i.spec.z, k, i.preset.dbscan_percentile, "dbscan_flag")


def forest_scores(rows: DataFrame, spec: FeatureSpec, seed: int = 42, trees: int = 50, name: str = "iso_score", sample_rows: int = FOREST_ROWS) -> DataFrame:
    """Grown on a bounded hash sample, applied to every row."""
    workers_find_package(rows.sparkSession)
    sample = rows.orderBy(draw(f"forest{seed}", F.col(spec.id)), spec.id).limit(sample_rows).select(*spec.z).collect()
    forest = Forest(np.array(sample, float).reshape(len(sample), -1), trees, seed=seed)

    @F.pandas_udf("double")
    def scored(*cols: pd.Series) -> pd.Series:
        return pd.Series(forest.score(np.column_stack([c.to_numpy(float) for c in cols])))

    return rows.withColumn(name, scored(*spec.z))


def _forest(i: Inputs) -> DataFrame:
    return stats.above(forest_scores(i.rows, i.spec, i.preset.seed), "iso_score", "isolation_forest_flag", i.preset.n_std["isolation_forest"])


def trained(i: Inputs, name: str):
    """The network and its weights, trained once for all detectors that use it."""

    def make():
        p = i.preset
        net = neural.network(name, len(i.spec.features), hidden=p.hidden, latent=p.latent, window=p.window)
        rows = i.sequences if net.sequence else i.vectors
        return net, neural.load(neural.train(rows, i.spec.id, "x", net, p.epochs, p.batch, p.seed), net)

    return i.shared(name, make)


def _deep(i: Inputs) -> DataFrame:
    net, w = trained(i, "autoencoder")
    rows = neural.score(i.vectors, "x", "latent", net, w, "latents")
    names = [f"latent{j}" for j in range(net.latent)]
    rows = rows.select(i.spec.id, *(F.round(F.col("latent")[j], stats.DIGITS).alias(n) for j, n in enumerate(names))).cache()  # read in each of Lloyd's rounds
    return stats.in_minority(cluster.kmeans(rows, i.spec.id, names, i.preset.deep_k, "deep_distance", "deep_cluster"), "deep_cluster", "deep_embedding_flag")


def _dagmm(i: Inputs) -> DataFrame:
    net, w = trained(i, "autoencoder")
    rows = neural.score(i.vectors, "x", "representation", net, w, "representation").select(i.spec.id, "representation").cache()
    rows = cluster.mixture(rows, "representation", i.preset.dagmm_k, "dagmm_cluster", i.preset.seed)
    return stats.above(rows.withColumn("dagmm_energy", cluster.energy(F.col("probability"))), "dagmm_energy", "dagmm_flag", i.preset.n_std["dagmm"])


def _network(name: str) -> Callable[[Inputs], DataFrame]:
    def run(i: Inputs) -> DataFrame:
        net, w = trained(i, name)
        rows = neural.score(i.sequences if net.sequence else i.vectors, "x", f"{name}_score", net, w)
        rows = rows.select(i.spec.id, f"{name}_score").cache()  # read for the threshold, then for the flags
        return (stats.above_or_zero if net.sequence else stats.above)(rows, f"{name}_score", f"{name}_flag", i.preset.n_std[name])

    return run


def _adaptive(i: Inputs) -> DataFrame:
    return stats.adaptive(i.rows, i.spec, i.preset.adaptive_target)


def _static(i: Inputs) -> DataFrame:
    return stats.static_z(i.rows, i.spec, i.preset.static_z)


#: In the order of the report; each adds ``<name>_flag``.
DETECTORS: dict[str, Callable[[Inputs], DataFrame]] = {
    "kmeans": _kmeans,
    "gmm": _gmm,
    "pca_kmeans": _pca,
    "dbscan": _dbscan,
    "isolation_forest": _forest,
    "deep_embedding": _deep,
    "dagmm": _dagmm,
    "vae": _network("vae"),
    "gan": _network("gan"),
    "usad": _network("usad"),
    "transformer": _network("transformer"),
    "lstm": _network("lstm"),
    "omnianomaly": _network("omnianomaly"),
    "adaptive": _adaptive,
}
#: Of the older ensemble of four.
FOUR = {"kmeans": _kmeans, "gmm": _gmm, "pca_kmeans": _pca, "static": _static}


#: Detectors that train a network.
NETWORK_OF = {"deep_embedding": "autoencoder", "dagmm": "autoencoder"}
TRAINED = frozenset(("deep_embedding", "dagmm", "vae", "gan", "usad", "transformer", "lstm", "omnianomaly"))


def prepared(rows: DataFrame, spec: FeatureSpec) -> DataFrame:
    """Repaired rows with z columns."""
    return stats.standardise(sequence.repair(rows, spec.id, list(spec.features)), spec)


def inputs(rows: DataFrame, spec: FeatureSpec, preset: Preset = DEFAULT) -> Inputs:
    """Repairs, standardises and keeps the rows for all detectors (in memory and on disk; they can be made again)."""
    rows = prepared(rows, spec).cache()
    slots = rows.sparkSession.sparkContext.defaultParallelism
    parts = slots * max(1, -(-rows.count() // (slots * PART_ROWS)))
    return Inputs(rows.coalesce(parts), spec, preset)  # a hundred fits' rounds run a task for each part


def fused(i: Inputs) -> DataFrame:
    """Flags of the detectors whose parameters are few numbers, vote and decision: one projection, no join, no shuffle.

    The parameters come from aggregates over all rows first. Half of the four flags make an anomaly.
    """
    key, z, p = i.spec.id, i.spec.z, i.preset
    flags = ["kmeans_flag", "pca_kmeans_flag", "static_flag", "adaptive_flag"]
    if i.rows.isEmpty():
        return i.rows.withColumns({f: F.lit(None).cast("int") for f in (*flags, "vote", "ensemble")})
    far, _ = cluster.nearest(z, cluster.lloyd(i.rows, key, z, p.kmeans_k))
    limit = stats.threshold(i.rows.select(far.alias("far")), "far", p.n_std["kmeans"])
    axes = cluster.components(i.rows, z, p.pca_dims)
    names = [f"pc{j}" for j in range(len(axes))]
    rows = cluster.project(i.rows, z, axes)
    _, at = cluster.nearest(names, cluster.lloyd(rows, key, names, p.pca_k))
    rare = stats.minority(rows.select(at.alias("cluster")), "cluster")
    rows = rows.withColumns({"kmeans_flag": (far > F.lit(limit)).cast("int"), "pca_kmeans_flag": (at == F.lit(rare)).cast("int")})
    rows = stats.adaptive(stats.static_z(rows, i.spec, p.static_z), i.spec, p.adaptive_target)
    return ensemble.vote(rows, flags, share=0.5).drop(*names)


def run_ensemble(rows: DataFrame, spec: FeatureSpec, preset: Preset = DEFAULT, names: list[str] | None = None) -> DataFrame:
    """Key, features, one flag per detector, vote and decision; an empty table gives an empty result."""
    known = DETECTORS | FOUR
    names = names or list(DETECTORS)
    flags = [f"{n}_flag" for n in names]
    if rows.isEmpty():
        return rows.select(spec.id, *spec.features, *(F.lit(0).alias(x) for x in (*flags, "vote", "ensemble")))
    i = inputs(rows, spec, preset)
    for n in names:  # one by one, as a training takes all slots
        if n in TRAINED:
            trained(i, NETWORK_OF.get(n, n))
    with ThreadPoolExecutor(TOGETHER) as pool:
        made = list(pool.map(lambda n: known[n](i), names))
    found = {n: (df, f"{n}_flag") for n, df in zip(names, made)}
    joined = ensemble.join_flags(i.rows.select(spec.id, *spec.features), spec.id, found)
    return ensemble.vote(joined, flags, share=preset.votes_share)
