"""Consistency checks; each returns the violations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlake.operators.prefixes import prefix_counts


def count_mismatches(stored: DataFrame, hot: DataFrame, min_length: int = 8) -> DataFrame:
    """Prefixes whose stored count is not what the hot set gives."""
    right = prefix_counts(hot, min_length).withColumnRenamed("hot_count", "recomputed")
    both = stored.select("length", "network", "hot_count").join(right, ["length", "network"], "full_outer")
    return both.where(~F.col("hot_count").eqNullSafe(F.col("recomputed")))


def negative_counts(stored: DataFrame) -> DataFrame:
    return stored.where("hot_count < 0")


def orphans(stored: DataFrame) -> DataFrame:
    """Nodes that hold nothing."""
    return stored.where("hot_count <= 0")


def record_mismatches(records: DataFrame, hot: DataFrame) -> DataFrame:
    """Addresses with a record but not hot, and the reverse."""
    a, b = records.select("ip"), hot.select("ip")
    return a.exceptAll(b).withColumn("problem", F.lit("extra")).unionByName(b.exceptAll(a).withColumn("problem", F.lit("missing")))


def hysteresis_violations(states: DataFrame, hot: int, cold: int) -> DataFrame:
    """Ticks whose state does not follow from the one before and the total."""
    before = F.lag("state", 1, 0).over(Window.partitionBy("ip").orderBy("t", "phase"))
    right = F.when(F.col("total") >= hot, 1).when(F.col("total") < cold, 0).otherwise(before)
    return states.withColumn("_right", right).where("state != _right").drop("_right")
