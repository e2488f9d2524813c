"""Quality levels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lowest score of each level, best first.
QUALITY_CUTOFFS = {"excellent": 0.9, "good": 0.8, "fair": 0.6, "poor": 0.0}
QUALITY_LEVELS = list(QUALITY_CUTOFFS)


def quality_level(score: Column) -> Column:
    """excellent / good / fair / poor."""
    return (
        F.when(score >= QUALITY_CUTOFFS["excellent"], "excellent")
        .when(score >= QUALITY_CUTOFFS["good"], "good")
        .when(score >= QUALITY_CUTOFFS["fair"], "fair")
        .otherwise("poor")
    )


def percent_text(ratio_percent: Column) -> Column:
    """``100.0`` as ``100.00%``."""
    return F.format_string("%.2f%%", ratio_percent)
