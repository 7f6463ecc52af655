"""Limits, modes and weights. The numbers are fixed values: results depend on them."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

MIB, GIB = 1 << 20, 1 << 30


@dataclass(frozen=True)
class Limits:
    images: int = 10_000
    recommended_images: int = 3_000
    entries: int = 25_000
    image_bytes: int = 75 * MIB
    total_bytes: int = 20 * GIB
    ratio: float = 100
    analysis_edge: int = 64
    thumbnail_edge: int = 360
    fingerprint_chunk: int = 64 * 1024

    def __post_init__(self) -> None:
        for f in fields(self):
            value = getattr(self, f.name)
            if not 0 < value < float("inf"):
                raise ValueError(f"limit {f.name} must be positive and finite")


@dataclass(frozen=True)
class Settings:
    """Thresholds of a run: those of its mode, unless replaced."""

    mode: str
    p: int
    d: int
    a: int
    ssim: float
    histogram: float
    top_k: int
    # what the mode alone decides
    certain: int = 0
    probable: int = 0
    review: int = 0
    review_ssim: float = 0.0
    aspect: float = 0.0
    feature: float = 0.0
    ai: float = 0.0
    label: str = ""

    def but(self, **changes) -> Settings:
        return replace(self, **changes)


# Thresholds by mode.
MODES = {
    "strict": Settings("strict", 8, 8, 8, 0.92, 0.80, 12, 93, 85, 68, 0.84, 0.04, 0.88, 0.92, "Streng"),
    "balanced": Settings("balanced", 14, 14, 14, 0.82, 0.65, 20, 89, 78, 60, 0.76, 0.10, 0.78, 0.86, "Ausgeglichen"),
    "sensitive": Settings("sensitive", 20, 20, 20, 0.68, 0.45, 32, 84, 68, 50, 0.64, 0.20, 0.68, 0.78, "Sensitiv"),
}
DEFAULT_MODE = "balanced"

# Weights of the evidence, in the order in which it is summed.
WEIGHTS = {"p": 0.28, "d": 0.14, "a": 0.08, "ssim": 0.30, "histogram": 0.10, "feature": 0.12, "ai": 0.08, "aspect": 0.04, "resolution": 0.02}
STRONG_SCORE = 84

TURNS = (0, 90, 180, 270)
# The gate before the expensive metrics.
SLACK, NEAR_EXACT, MOST_ASPECT, MOST_LUMINANCE = 3, 4, 0.38, 0.35
# The gate for records without rotated hashes.
TURN_ASPECT, TURN_LUMINANCE, TURN_CLOSEST, TURN_MEAN = 0.08, 0.08, 32, 38
EPSILON = 2.0**-52


def worker_count(cores: int) -> int:
    """All cores but one, from 1 to 4."""
    return max(1, min(4, cores - 1))
