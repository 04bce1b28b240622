"""Settings of a retrieval run, as values instead of environment variables."""

from __future__ import annotations

from dataclasses import dataclass

#: Other names by which modes are known.
FUSION_ALIASES = {"harmonic": "harmonic", "prod": "harmonic", "min": "min", "mean": "mean"}
CHAIN_ALIASES = {"add": "add", "plus": "add", "prod": "prod"}


@dataclass(frozen=True)
class RetrievalConfig:
    """Unknown fusion modes mean harmonic and unknown chain modes mean add, as in production scripts."""

    fusion: str = "harmonic"
    chain: str = "add"
    clip_to_zero: bool = False
    main_weight: float = 2.0
    max_gap_ms: int = 60_000
    discount: float = 0.9
    position: str = "middle"
    slide_threshold: float = 0.95
    max_per_video: int = 10
    overlap_ms: int = 5_000
    top_videos: int = 10
    candidate_frames: int = 2_000
    smoothing_window: int = 3
    smoothing_sigma: float = 1.0

    @property
    def fusion_mode(self) -> str:
        return FUSION_ALIASES.get(self.fusion, "harmonic")

    @property
    def chain_mode(self) -> str:
        return CHAIN_ALIASES.get(self.chain, "add")


PRODUCTION = RetrievalConfig(clip_to_zero=True, main_weight=3.0, max_gap_ms=6_000, discount=0.8, position="second", overlap_ms=0, smoothing_window=0)
