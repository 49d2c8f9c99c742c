"""Confidence bands and display texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HIGH, MEDIUM = 0.8, 0.5


def confidence_band(confidence: Column) -> Column:
    return F.when(confidence >= HIGH, "high").when(confidence >= MEDIUM, "medium").otherwise("low")


def confidence_level(confidence: Column) -> Column:
    """Four display tiers."""
    return (
        F.when(confidence >= 0.9, "critical")
        .when(confidence >= 0.8, "high")
        .when(confidence >= 0.7, "medium")
        .otherwise("low")
    )


def confidence_text(confidence: Column) -> Column:
    """Two decimals and the display weight: strong, warning or info."""
    weight = F.when(confidence >= 0.8, "strong").when(confidence >= 0.7, "warning").otherwise("info")
    return F.concat(F.format_string("%.2f", F.bround(confidence, 2)), F.lit(" "), weight)
