"""Hot prefixes: predicate, minimal set, onset times, gauges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlake.config import DetectionConfig
from emberlake.functions.addressing import capacity, mask
from emberlake.operators.ordering import previous, running_sum


def is_hot_prefix(hot_count: Column, length: Column, minimum_hot_ips: int, minimum_hot_ratio: float, bits: int = 32) -> Column:
    """Enough hot addresses and enough of the capacity; exact, as the capacity is a power of two."""
    size = capacity(length, bits).cast("double") if bits <= 32 else F.pow(F.lit(2.0), F.lit(bits) - length)
    return (hot_count >= minimum_hot_ips) & (hot_count.cast("double") / size >= F.lit(float(minimum_hot_ratio)))


def with_state(counts: DataFrame, cfg: DetectionConfig) -> DataFrame:
    hot = is_hot_prefix(F.col("hot_count"), F.col("length"), cfg.minimum_hot_ips, cfg.minimum_hot_ratio)
    return counts.withColumn("state", F.when(hot, "HOT_PREFIX").otherwise("NORMAL"))


def minimal(qualifying: DataFrame) -> DataFrame:
    """Qualifying prefixes without a qualifying descendant.

    A qualifying descendant implies a qualifying child: if the child above the
    descendant falls short, it does so on the ratio, so its sibling has the higher one
    and qualifies. Needs every length down to the host routes in the input.
    """
    parents = qualifying.where("length > 0").select((F.col("length") - 1).alias("length"), mask(F.col("network"), F.col("length") - 1).alias("network")).distinct()
    return qualifying.join(parents, ["length", "network"], "left_anti")


def listed(prefixes: DataFrame) -> DataFrame:
    """The listing's order as a column: longest first, then by address. A listing is short; its rank needs one order."""
    return prefixes.withColumn("position", F.row_number().over(Window.orderBy(F.desc("length"), F.asc("network"))))


def classification_changes(changelog: DataFrame, cfg: DetectionConfig) -> DataFrame:
    """The rows of a stats changelog at which a prefix's state changes."""
    states = previous(with_state(changelog, cfg), ["length", "network"], "state", "t", ["t", "phase", "ip"], F.lit("NORMAL"), "_before")
    return states.where("state != _before").drop("_before")


def detections(changelog: DataFrame, cfg: DetectionConfig) -> DataFrame:
    """(length, network, hot_count, since) of the prefixes that are hot after the last change; since: when they last became so."""
    newest = F.struct("t", "phase", "ip")
    changes = classification_changes(changelog, cfg).groupBy("length", "network").agg(F.max_by(F.struct("state", "t"), newest).alias("_change"))
    last = changelog.groupBy("length", "network").agg(F.max_by("hot_count", newest).alias("hot_count"))
    return changes.where("_change.state = 'HOT_PREFIX'").join(last, ["length", "network"]).select("length", "network", "hot_count", F.col("_change.t").alias("since"))


def detection_gauges(found: DataFrame, changes: DataFrame) -> DataFrame:
    """One row: hot_prefixes, minimal ones (candidates), classification_changes."""
    one = found.agg(F.count("*").alias("hot_prefixes"))
    least = minimal(found).agg(F.count("*").alias("bot_network_candidates"))
    return one.crossJoin(least).crossJoin(changes.agg(F.count("*").alias("classification_changes")))  # one row each


__all__ = ["classification_changes", "detection_gauges", "detections", "is_hot_prefix", "listed", "minimal", "running_sum", "with_state"]
