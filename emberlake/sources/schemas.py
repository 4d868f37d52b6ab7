"""Explicit schemas of the messages, and the registry of datasets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

OBSERVATION_PAYLOAD = "agent_id string, sequence bigint, window_start string, window_seconds int, observations array<struct<ip: string, request_count: bigint>>"
HOT_IP_PAYLOAD = "type string, ip string, family string, timestamp string, sequence bigint, shard int, window_count bigint, config_version int, attributes string"
PREFIX_STATS_PAYLOAD = "prefix string, hot_count bigint, capacity string, hot_ratio double, sequence bigint, timestamp string"
ENVELOPE = "event_id string, agent_id string, sequence bigint, event_type string, config_version int, timestamp string, schema_version int, subject string"

PAYLOADS = {"RequestObservation": OBSERVATION_PAYLOAD, "HotIpAdded": HOT_IP_PAYLOAD, "HotIpRemoved": HOT_IP_PAYLOAD, "PrefixStatsChanged": PREFIX_STATS_PAYLOAD}

LOG = T.StructType(
    [T.StructField("topic", T.StringType()), T.StructField("partition", T.IntegerType()), T.StructField("offset", T.LongType()), T.StructField("key", T.StringType()), T.StructField("message_id", T.StringType()), T.StructField("value", T.StringType())]
)


@dataclass(frozen=True)
class Topic:
    """A log: its partitions, retention in days, and the column its key comes from."""

    name: str
    partitions: int
    retention_days: int
    key: str


#: The four logs, and the span in which a log drops repeated message ids.
TOPICS = {t.name: t for t in (Topic("observations", 128, 1, "ip"), Topic("reconciliation", 8, 7, "ip"), Topic("hot-ip", 32, 30, "ip"), Topic("prefix-stats", 4, 1, "prefix"))}
DUPLICATE_WINDOW_SECONDS = 120
