"""One source of truth for every knob of the pipeline; the defaults are the effective ones of each step."""

from __future__ import annotations

from dataclasses import dataclass

POOLING = ("percentile", "mean", "median", "max", "min")
CENTERING = ("none", "col", "row", "both")
INITS = ("medoid", "random")
METRICS = ("euclidean", "cosine")


@dataclass(frozen=True)
class PipelineConfig:
    # media
    sanitize_names: bool = True
    normalize: bool = True
    target_resolution: int | None = None
    uniform_resolution: bool = False
    force_reimport: bool = False
    fps: int = 3
    overwrite_frames: bool = True
    # scoring and pooling
    model: str = "ViT-B/16"
    aggregation: str = "percentile"
    percentile: float = 95
    # reweighting
    centering: str = "col"
    variance_threshold: float = 0.95
    component_cap: int = 32
    beta: float = 0.5
    # strata
    n_strata: int | str = "auto"
    k_embed: int = 16
    init: str = "medoid"
    normalize_embedding: bool = True
    min_stratum_size: int = 3
    target_max_dist: float = 0.35
    strata_cap: int | None = None
    # selection
    n_compilations: int = 10
    comp_min_seconds: float = 55.0
    comp_max_seconds: float = 65.0
    anchor_metric: str = "euclidean"
    coherence_power: float = 1.0
    diversity_power: float = 1.0
    seed: int | None = None
    # interchangeability test
    null_draws: int = 2000
    permutations: int = 3000
    eps_std: float = 1e-8
    alpha: float = 0.05

    def __post_init__(self) -> None:
        for value, allowed, what in ((self.aggregation, POOLING, "aggregation"), (self.centering, CENTERING, "centering"), (self.init, INITS, "init"), (self.anchor_metric, METRICS, "anchor_metric")):
            if value not in allowed:
                raise ValueError(f"unknown {what} {value!r}; one of {', '.join(allowed)}")
        if self.n_strata != "auto" and (not isinstance(self.n_strata, int) or self.n_strata < 1):
            raise ValueError("n_strata must be 'auto' or a whole number of at least 1")
        if self.n_compilations < 1:
            raise ValueError("n_compilations must be at least 1")
        if not 0 <= self.percentile <= 100:
            raise ValueError("percentile must lie between 0 and 100")

    @property
    def effective_seed(self) -> int:
        """No seed, and seed 0, stand for 1234."""
        return self.seed or 1234
