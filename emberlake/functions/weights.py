"""Weights of hot addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def threshold_ratio(count: Column, hot_threshold: Column | int, weight_max: int = 1_000_000) -> Column:
    """1000 * count / hot, rounded half up in integers, clamped to [0, weight_max]."""
    hot = F.lit(hot_threshold).cast("long") if isinstance(hot_threshold, int) else hot_threshold.cast("long")
    halved = F.floor(hot / 2)
    total = 1000 * count.cast("long") + halved
    return F.least(F.greatest((total - F.pmod(total, hot)) / hot, F.lit(0.0)), F.lit(float(weight_max))).cast("long")


def transition_attributes(weight: Column) -> Column:
    """The canonical attribute document of a transition."""
    return F.to_json(F.struct(F.lit(1).alias("attributes_version"), weight.alias("weight")))
