"""Default rule parameters and session settings."""
from __future__ import annotations

from dataclasses import dataclass

# Hot join keys are split at run time even when the next operator wants the same clustering.
SESSION_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


@dataclass(frozen=True)
class StatsConfig:
    trade_window_ticks: int = 320
    tick_rate: float | None = None


@dataclass(frozen=True)
class SpatialConfig:
    sample_every: int = 16
    coordinate_limit: float = 1e6
    normal_gap: int = 16
    large_gap: int = 64
    jump_planar: float = 1024.0
    jump_vertical: float = 512.0


@dataclass(frozen=True)
class FactConfig:
    checkpoints: tuple[int, ...] = (640, 1280, 1920)
    early_window: int = 1280


@dataclass(frozen=True)
class EconomyConfig:
    full_buy: int = 20000
    force_spent: int = 10000
    eco_value: int = 7500
    eco_spent: int = 5000


@dataclass(frozen=True)
class PatternConfig:
    min_sample: int = 5
    corpus_matches: int = 15
    z: float = 1.959963984540054
