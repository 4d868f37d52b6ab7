"""The read API as DataFrame functions with the columns of the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlake.config import DetectionConfig
from emberlake.functions.addressing import VIEW_LENGTHS, format_ipv4, mask
from emberlake.operators.classify import detections, listed, minimal, with_state
from emberlake.operators.prefixes import hot_counts_of, prefix_counts, with_stats


def prefix_view(prefixes: DataFrame, counts: DataFrame, cfg: DetectionConfig) -> DataFrame:
    """prefix, hot_ips, capacity, hot_ratio, state of (length, network) rows; zero-valued where nothing is hot."""
    return with_state(with_stats(hot_counts_of(prefixes, counts)), cfg).select("length", "network", "prefix", F.col("hot_count").alias("hot_ips"), "capacity", "hot_ratio", "state")


def ip_view(addresses: DataFrame, hot: DataFrame, counts: DataFrame, cfg: DetectionConfig) -> DataFrame:
    """ip, state, request_count, attributes and matched_prefixes (lengths 8, 16, 24) of each address."""
    lengths = addresses.select("ip").distinct().withColumn("length", F.explode(F.array(*map(F.lit, VIEW_LENGTHS))))
    at = lengths.withColumn("network", mask(F.col("ip"), F.col("length")))
    stats = with_state(with_stats(hot_counts_of(at, counts)), cfg)
    matched = stats.groupBy("ip").agg(F.sort_array(F.collect_list(F.struct("length", "prefix", F.col("hot_count").alias("hot_ips"), "capacity", "hot_ratio", "state"))).alias("matched_prefixes"))
    known = hot.select("ip", "attributes", "request_count")
    out = addresses.select("ip").join(known, "ip", "left").join(matched, "ip")
    is_hot = F.col("request_count").isNotNull()
    return out.select(
        "ip", format_ipv4(F.col("ip")).alias("address"), F.when(is_hot, "HOT").otherwise("COLD").alias("state"), F.coalesce("request_count", F.lit(0).cast("long")).alias("request_count"),
        F.when(is_hot, F.coalesce("attributes", F.lit('{"attributes_version":1}'))).alias("attributes"), "matched_prefixes")


def hot_prefixes(hot: DataFrame, cfg: DetectionConfig, min_length: int = 8, only_minimal: bool = False) -> DataFrame:
    """The listing of hot prefixes, with its order in ``position``."""
    found = with_state(with_stats(prefix_counts(hot, min_length)), cfg).where("state = 'HOT_PREFIX'")
    return listed(minimal(found) if only_minimal else found).select("position", "length", "network", "prefix", F.col("hot_count").alias("hot_ips"), "capacity", "hot_ratio", "state")


def current_detections(changelog: DataFrame, cfg: DetectionConfig, only_minimal: bool = False) -> DataFrame:
    """The detector's list: hot prefixes and since when, in listing order."""
    found = detections(changelog, cfg)
    return with_stats(listed(minimal(found) if only_minimal else found)).withColumn("state", F.lit("HOT_PREFIX"))
