"""Detection as a scan: the state of one service, or of some of its features, and its update by one feature vector.

The same formulas as the window expressions, one observation at a time.
"""

from __future__ import annotations

import math
from collections import deque

from ..config import DetectionConfig, SeverityThresholds
from ..functions.scoring import LEAST_BASE, SCORE_DIGITS
from ..schemas import FEATURES, family_of


class FeatureState:
    """The last values and the exponentially weighted moments of one feature."""

    def __init__(self, size: int):
        self.values: deque[float] = deque(maxlen=size)
        self.count, self.mean, self.var, self.last = 0, 0.0, 0.0, None

    def baseline(self, config: DetectionConfig) -> tuple[float, float] | None:
        b = config.baseline
        rolling = ewma = None
        if len(self.values) >= b.min_points:
            mean = math.fsum(self.values) / len(self.values)
            var = math.fsum((x - mean) ** 2 for x in self.values) / len(self.values)
            rolling = (mean, max(math.sqrt(var), b.std_floor))
        if self.count >= b.min_points:
            ewma = (self.mean, max(math.sqrt(self.var), b.std_floor))
        if b.strategy == "rolling":
            return rolling
        if b.strategy == "ewma":
            return ewma
        if rolling and ewma:
            return rolling[0], max(rolling[1], ewma[1])
        return rolling or ewma

    def add(self, x: float, alpha: float) -> None:
        if self.count == 0:
            self.mean, self.var = x, 0.0
        else:
            self.mean = alpha * x + (1 - alpha) * self.mean
            self.var = alpha * (x - self.mean) ** 2 + (1 - alpha) * self.var
        self.values.append(x)
        self.count += 1
        self.last = x


def _rank(value: float | None, t: SeverityThresholds) -> int:
    if value is None:
        return 0
    return sum(abs(value) >= limit for limit in (t.low, t.medium, t.high, t.critical))


def _part(value: float | None, critical: float) -> float:
    return 0.0 if value is None or critical == 0 else min(abs(value) / critical, 1.0)


class ServiceState:
    def __init__(self, config: DetectionConfig):
        self.config = config
        self.features = {f: FeatureState(config.baseline.window_size) for f in FEATURES}

    def update(self, vector: dict) -> list[dict]:
        """Anomalies of one window, suppressed ones marked; then the window becomes history."""
        c, found = self.config, []
        for ordinal, feature in enumerate(FEATURES):
            x = vector.get(feature)
            if x is None or x != x:
                continue
            x, state = float(x), self.features[feature]
            base = state.baseline(c)
            if base is not None:
                mean, std = base
                z = (x - mean) / std if std >= c.baseline.std_floor else None
                rate = None if state.last is None else abs(x - state.last) / max(abs(state.last), LEAST_BASE)
                weights = c.scoring
                score = weights.zscore_weight * _part(z, c.zscore.critical)
                score += weights.rate_change_weight * _part(rate, c.rate_change.critical)
                score = round(max(0.0, min(score, 1.0)), SCORE_DIGITS)
                rank = max(_rank(z, c.zscore), _rank(rate, c.rate_change))
                if score >= weights.score_floor and rank > 0:
                    found.append(
                        {
                            "feature": feature, "ordinal": ordinal, "observed": x, "baseline_mean": mean, "baseline_std": std,
                            "z_score": z, "rate_change": rate, "score": score, "severity_rank": rank,
                            "direction": "high" if x >= mean else "low", "suppressed": False,
                        }
                    )
            state.add(x, c.baseline.ewma_alpha)
        if c.suppress_redundant:
            best: dict[str, dict] = {}
            for a in sorted(found, key=lambda a: (-a["score"], a["ordinal"])):
                a["suppressed"] = family_of(a["feature"]) in best
                best.setdefault(family_of(a["feature"]), a)
        return found

    def rows(self) -> dict[str, tuple]:
        """(last values, count, mean, variance, last value) of each feature that has been seen."""
        return {k: (list(s.values), s.count, s.mean, s.var, s.last) for k, s in self.features.items() if s.count}

    @classmethod
    def of(cls, rows: dict[str, tuple], config: DetectionConfig) -> ServiceState:
        state = cls(config)
        for k, (values, count, mean, var, last) in rows.items():
            s = state.features[k]
            s.values.extend(values)
            s.count, s.mean, s.var, s.last = count, mean, var, last
        return state
