"""Parameters of every stage, with their bounds. Passed explicitly; importing has no side effects."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, is_dataclass, replace


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


@dataclass(frozen=True)
class SeverityThresholds:
    low: float
    medium: float
    high: float
    critical: float

    def __post_init__(self) -> None:
        values = (self.low, self.medium, self.high, self.critical)
        _need(all(v >= 0 for v in values), "thresholds must not be negative")


@dataclass(frozen=True)
class BaselineConfig:
    window_size: int = 20
    min_points: int = 10
    std_floor: float = 1e-6
    ewma_alpha: float = 0.2
    strategy: str = "hybrid"

    def __post_init__(self) -> None:
        _need(self.window_size >= 3, "window_size must be at least 3")
        _need(self.min_points >= 3, "min_points must be at least 3")
        _need(self.std_floor > 0, "std_floor must be positive")
        _need(0 < self.ewma_alpha < 1, "ewma_alpha must lie between 0 and 1")
        _need(self.strategy in ("rolling", "ewma", "hybrid"), f"unknown baseline strategy: {self.strategy}")


@dataclass(frozen=True)
class ScoringConfig:
    zscore_weight: float = 0.7
    rate_change_weight: float = 0.3
    score_floor: float = 0.2


@dataclass(frozen=True)
class DetectionConfig:
    zscore: SeverityThresholds = SeverityThresholds(2.5, 3.5, 5.0, 7.0)
    rate_change: SeverityThresholds = SeverityThresholds(0.75, 1.25, 2.0, 3.0)
    baseline: BaselineConfig = BaselineConfig()
    scoring: ScoringConfig = ScoringConfig()
    suppress_redundant: bool = True


@dataclass(frozen=True)
class WindowConfig:
    seconds: int = 300

    def __post_init__(self) -> None:
        _need(self.seconds > 0, "window size must be positive")


@dataclass(frozen=True)
class IncidentConfig:
    max_gap_seconds: int = 600
    window_size_seconds: int = 300
    require_feature_family_overlap: bool = True
    context_window_seconds: int = 300
    max_log_patterns: int = 10
    max_operational_events: int = 10
    merge_across_services: bool = False

    def __post_init__(self) -> None:
        _need(self.max_gap_seconds >= 0 and self.context_window_seconds >= 0, "durations must not be negative")
        _need(self.window_size_seconds > 0, "window size must be positive")
        _need(self.max_log_patterns >= 0 and self.max_operational_events >= 0, "limits must not be negative")


@dataclass(frozen=True)
class ModelConfig:
    """Generation limits handed to a pluggable model."""

    max_new_tokens: int = 512
    temperature: float = 0.0
    top_p: float = 0.9
    repetition_penalty: float = 1.05


@dataclass(frozen=True)
class Settings:
    window: WindowConfig = field(default_factory=WindowConfig)
    detection: DetectionConfig = field(default_factory=DetectionConfig)
    incident: IncidentConfig = field(default_factory=IncidentConfig)
    model: ModelConfig = field(default_factory=ModelConfig)


def _override(config, values: Mapping):
    changes = {}
    known = {f.name for f in fields(config)}
    for name, value in values.items():
        _need(name in known, f"unknown setting: {name}")
        old = getattr(config, name)
        changes[name] = _override(old, value) if is_dataclass(old) else value
    return replace(config, **changes)


def load_settings(prefix: str = "LOGSIEVE_", environ: Mapping[str, str] | None = None) -> Settings:
    """Settings with each section overridden by one JSON object in the environment, e.g. LOGSIEVE_WINDOW."""
    environ = os.environ if environ is None else environ
    found = {f.name: json.loads(environ[k]) for f in fields(Settings) if (k := prefix + f.name.upper()) in environ}
    return _override(Settings(), found)
