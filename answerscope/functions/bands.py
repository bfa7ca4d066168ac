"""Threshold ladders: risk bands, overlap tiers, verdicts, performance tiers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values: (lower bound, label), highest first; the last label has no bound.
RISK_BANDS = ((0.8, "low_risk"), (0.5, "medium_risk"), (None, "high_risk"))

PERFORMANCE_TIERS = ((0.8, "excellent"), (0.6, "good"), (0.4, "average"), (None, "poor"))

OVERLAP_TIERS = (
    (0.8, "very_high"), (0.6, "high"), (0.4, "moderate"), (0.2, "low"),
)
OVERLAP_TIER_NAMES = ("very_high", "high", "moderate", "low", "very_low", "none")
RISKY_TIERS = ("very_low", "none")
EXPLICIT_TIERS = ("very_high", "high")

OVERLAP_VERDICTS = (
    (80.0, "excellent"), (60.0, "good"), (40.0, "moderate"), (20.0, "worrying"), (None, "critical"),
)


def ladder(value: Column, steps) -> Column:
    """First label whose bound ``value`` reaches; null reaches none."""
    out = None
    for bound, label in steps:
        if bound is None:
            return out.otherwise(label)
        out = F.when(value >= bound, label) if out is None else out.when(value >= bound, label)
    return out


def risk_band(score: Column) -> Column:
    """A missing score counts as 0 and is therefore high risk."""
    return ladder(F.coalesce(score, F.lit(0.0)), RISK_BANDS)


def overlap_tier(overlap: Column) -> Column:
    return ladder(overlap, OVERLAP_TIERS).when(overlap > 0, "very_low").otherwise("none")


def overlap_verdict(percent: Column) -> Column:
    return ladder(percent, OVERLAP_VERDICTS)


def performance_tier(mean_score: Column) -> Column:
    return ladder(mean_score, PERFORMANCE_TIERS)


def correlation_strength(r: Column) -> Column:
    return F.when(F.abs(r) > 0.5, "strong").when(F.abs(r) > 0.3, "moderate").otherwise("weak")


def correlation_direction(r: Column) -> Column:
    return F.when(r > 0, "positive").otherwise("negative")
