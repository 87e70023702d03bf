"""Detector, score and severity expressions. Severities are ranks 0..4 until they are named."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import ScoringConfig, SeverityThresholds
from ..schemas import SEVERITIES

# Fixed value: least denominator of a rate of change.
LEAST_BASE = 1e-6
SCORE_DIGITS = 12


def zscore(x: Column, mean: Column, std: Column, min_std: float) -> Column:
    return F.when(std >= min_std, (x - mean) / std)


def rate_of_change(x: Column, previous: Column) -> Column:
    return F.abs(x - previous) / F.greatest(F.abs(previous), F.lit(LEAST_BASE))


def _part(value: Column, critical: float) -> Column:
    if critical == 0:
        return F.lit(0.0)
    return F.coalesce(F.least(F.abs(value) / critical, F.lit(1.0)), F.lit(0.0))


def combined_score(z: Column, rate: Column, zs: SeverityThresholds, rs: SeverityThresholds, weights: ScoringConfig) -> Column:
    total = weights.zscore_weight * _part(z, zs.critical) + weights.rate_change_weight * _part(rate, rs.critical)
    # Rounded far below any meaning, so that the order of a sum can't decide at the floor.
    return F.round(F.greatest(F.lit(0.0), F.least(total, F.lit(1.0))), SCORE_DIGITS)


def severity_rank(value: Column, t: SeverityThresholds) -> Column:
    v = F.abs(value)
    return (
        F.when(v >= t.critical, 4).when(v >= t.high, 3).when(v >= t.medium, 2).when(v >= t.low, 1).otherwise(0)
    )


def severity_name(rank: Column) -> Column:
    return F.get(F.array(*map(F.lit, SEVERITIES)), rank)


def deviation_class(deviation: Column) -> Column:
    return F.when(deviation > 5, "critical").when(deviation > 1, "high").otherwise("medium")
