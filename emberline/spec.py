"""Which columns are features, and the tuned constants of the detectors."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class FeatureSpec:
    """The key column, which also is the order of the rows, and the numeric feature columns."""

    id: str = "id"
    features: tuple[str, ...] = ("value", "gap_s", "ugap_s", "k")

    @property
    def z(self) -> list[str]:
        return [f"z_{c}" for c in self.features]


@dataclass(frozen=True)
class Preset:
    """Constants of one generation of the ensemble. ``n_std`` is by detector."""

    kmeans_k: int = 2
    gmm_k: int = 6
    pca_dims: int = 2
    pca_k: int = 4
    dbscan_percentile: float = 0.97
    dbscan_k_per_feature: int = 3
    deep_k: int = 8
    dagmm_k: int = 5
    adaptive_target: float = 0.02
    static_z: float = 3.0
    votes_share: float = 0.25
    epochs: int = 30
    window: int = 5
    batch: int = 256
    hidden: int = 16
    latent: int = 2
    seed: int = 42
    n_std: dict[str, float] = field(default_factory=lambda: {"kmeans": 2.0, "isolation_forest": 2.6, "dagmm": 3.0, "vae": 1.3, "gan": 2.5, "usad": 1.2, "transformer": 0.2, "lstm": 0.5, "omnianomaly": 0.6})


DEFAULT = Preset()
FOURTEEN = Preset(gmm_k=3, pca_k=2, dbscan_percentile=0.95, dbscan_k_per_feature=2, deep_k=2, dagmm_k=3, adaptive_target=0.05, votes_share=0.5, epochs=15, window=10, n_std={"kmeans": 0.7, "isolation_forest": 2.3, "dagmm": 0.3, "vae": 1.8, "gan": 1.5, "usad": 0.3, "transformer": 0.75, "lstm": 0.6, "omnianomaly": 1.5})
FOUR = Preset(gmm_k=3, pca_k=2, votes_share=0.5, n_std={"kmeans": 3.0})
PRESETS = {"default": DEFAULT, "fourteen": FOURTEEN, "four": FOUR}
