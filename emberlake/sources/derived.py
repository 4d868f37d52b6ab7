"""Observations and dimension tables derived from the supplied test tables.

The events table has no addresses: user ids become hosts from 10.20.30.0 on, event
types become agents, event ids sequences, and values request counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlake.config import DetectionConfig
from emberlake.functions.timebuckets import bucket_start, epoch_seconds

BASE_ADDRESS = 169090560  # 10.20.30.0
#: Parameters scaled to the events' density.
CONFIG = DetectionConfig(window_seconds=172800, bucket_seconds=3600, hot_threshold=200, cold_threshold=120, allowed_lateness_seconds=1800, state_retention_seconds=345600)
#: A shorter window, within which the late observations' clock reaches every outcome.
LATE_CONFIG = DetectionConfig(window_seconds=86400, bucket_seconds=3600, hot_threshold=200, cold_threshold=120, allowed_lateness_seconds=1800, state_retention_seconds=345600)
SHARDS = 8


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """agent_id, sequence, ip, request_count, t, bucket."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    seconds = epoch_seconds(F.col("ts"))
    return events.select(
        F.col("event_type").alias("agent_id"),
        F.col("event_id").alias("sequence"),
        (F.lit(BASE_ADDRESS).cast("long") + F.col("user_id")).alias("ip"),
        F.floor("value").cast("long").alias("request_count"),
        seconds.alias("t"),
        bucket_start(seconds, CONFIG.bucket_seconds).alias("bucket"),
    )


def late_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations with a processing clock that runs from behind to far ahead, and a window length of their own."""
    obs = observations(spark, sf_dir)
    return obs.withColumn("now", F.col("t") + F.pmod(F.col("sequence") * 7919, F.lit(120000)) - 10000).withColumn("window_seconds", F.when(F.col("sequence") % 50 == 0, 90000).otherwise(3600))


def declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix metadata, a row for each key: a /24 for each nation with its region as tag, and rows for 10.0.0.0/8."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    region = spark.read.parquet(f"{sf_dir}/region.parquet")
    own = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.lit(24).alias("length"), (F.lit(BASE_ADDRESS).cast("long") + F.col("n_nationkey") * 256).alias("network"), F.lit("zone").alias("key"), F.lit("tags").alias("kind"),
        F.col("r_name").alias("tag"), F.lit(None).cast("long").alias("bits"), F.lit(None).cast("string").alias("override"))
    return own.unionByName(spark.sql(
        """SELECT * FROM VALUES
        (8, 167772160L, 'zone', 'tags', 'internal', CAST(NULL AS BIGINT), CAST(NULL AS STRING)),
        (8, 167772160L, 'flags', 'bitmask', NULL, 1L, NULL), (16, 169082880L, 'flags', 'bitmask', NULL, 6L, NULL),
        (8, 167772160L, 'owner', 'override', NULL, NULL, 'core'), (24, 169090560L, 'owner', 'override', NULL, NULL, 'edge'),
        (24, 169090816L, 'flags', 'override', NULL, NULL, 'odd')
        AS t(length, network, key, kind, tag, bits, override)"""))  # fmt: skip
