"""Append-only logs as Parquet folders: keyed publishing, replay, bounds, snapshots."""

from __future__ import annotations

import hashlib
import hmac
import json
import re
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlake.functions.hashing import partition_for
from emberlake.operators.folds import claims
from emberlake.operators.ordering import numbered
from emberlake.sources.schemas import DUPLICATE_WINDOW_SECONDS, LOG, OBSERVATION_PAYLOAD, TOPICS


def provision(spark: SparkSession, path: str) -> DataFrame:
    """The log at ``path``, made empty if it is not there; an error if it has another schema."""
    try:
        have = spark.read.parquet(path)
    except Exception as error:  # noqa: BLE001  the condition tells a missing folder from others
        if "PATH_NOT_FOUND" not in str(error):
            raise
        spark.createDataFrame([], LOG).write.parquet(path)
        return spark.read.schema(LOG).parquet(path)
    if [(f.name, f.dataType) for f in have.schema] != [(f.name, f.dataType) for f in LOG]:
        raise ValueError(f"{path} has another schema: {have.schema.simpleString()}")
    return have


def publish(spark: SparkSession, path: str, topic: str, rows: DataFrame) -> DataFrame:
    """Append rows (key, message_id, value, published_at order column) to a log and return what was added.

    A message_id that the log has, or that came twice, is dropped. Offsets follow on
    each partition's last; a partition is the FNV-1a hash of the key.
    """
    log = provision(spark, path)
    fresh = rows.withColumn("_nth", F.row_number().over(Window.partitionBy("message_id").orderBy("position"))).where("_nth = 1").drop("_nth")
    fresh = fresh.join(log.select("message_id").distinct(), "message_id", "left_anti")
    fresh = fresh.withColumn("partition", partition_for(F.col("key"), TOPICS[topic].partitions))
    ends = bounds(log).select("partition", "end_offset")
    out = numbered(fresh, ["partition"], "position", ["position"], "_nth", 1 << 20).join(F.broadcast(ends), "partition", "left")  # a row for each partition of the topic
    out = out.select(F.lit(topic).alias("topic"), "partition", (F.coalesce("end_offset", F.lit(0)) + F.col("_nth")).cast("long").alias("offset"), "key", "message_id", "value")
    out.write.mode("append").parquet(path)
    return out


def bounds(log: DataFrame) -> DataFrame:
    """(partition, first_offset, end_offset, last_value)."""
    return log.groupBy("partition").agg(F.min("offset").alias("first_offset"), (F.max("offset") + 1).alias("end_offset"), F.max_by("value", "offset").alias("last_value"))


def replay(log: DataFrame, start_offset: int = 0) -> DataFrame:
    """Every message from an offset on; nothing is acknowledged."""
    return log.where(F.col("offset") >= start_offset)


def unhandled(log: DataFrame, positions: DataFrame) -> DataFrame:
    """Messages at or after each partition's position (partition, position), redeliveries once."""
    done = positions.select(F.col("partition").alias("_p"), "position")
    return log.join(done, F.col("partition") == F.col("_p"), "left").where(F.col("position").isNull() | (F.col("offset") >= F.col("position"))).drop("_p", "position").dropDuplicates(["partition", "offset"])


def misrouted(log: DataFrame, topic: str) -> DataFrame:
    """Messages that are not on their key's partition."""
    return log.where(partition_for(F.col("key"), TOPICS[topic].partitions) != F.col("partition"))


def snapshot(hot: DataFrame, positions: DataFrame, as_of: int, config_version: int, path: str) -> None:
    """Write the hot set with its records, and the position of each shard it stands for."""
    hot.withColumn("as_of", F.lit(as_of)).withColumn("config_version", F.lit(config_version)).write.mode("overwrite").parquet(f"{path}/hot")
    positions.write.mode("overwrite").parquet(f"{path}/positions")


def restore(spark: SparkSession, path: str, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The snapshot's hot set, and the events after it. An error if the log no longer reaches back to the snapshot, or is another log."""
    hot, positions = spark.read.parquet(f"{path}/hot"), spark.read.parquet(f"{path}/positions")
    have = log.groupBy("shard").agg(F.min("sequence").alias("first"), (F.max("sequence") + 1).alias("end"))
    gap = positions.join(have, "shard", "left").where("first is null and event_sequence > 0 or first > event_sequence or end < event_sequence")
    if gap.take(1):
        raise ValueError("the log has a gap after the snapshot, or was made anew")
    return hot, log.join(positions.select(F.col("shard").alias("_s"), "event_sequence"), F.col("shard") == F.col("_s"), "left").where("event_sequence is null or sequence >= event_sequence").drop("_s", "event_sequence")


def resume(hot: DataFrame, tail: DataFrame) -> DataFrame:
    """The hot set after the events that follow a snapshot: (ip, attributes, request_count, since)."""
    seen = tail.groupBy("ip").agg(F.max_by(F.struct("type", "attributes", "window_count", "t"), F.struct("t", "phase")).alias("_last"))
    both = hot.select("ip", "attributes", "request_count", "since").join(seen, "ip", "full_outer")
    kept = both.where("_last is null or _last.type = 'HotIpAdded'")
    pick = lambda new, old: F.when(F.col("_last").isNotNull(), F.col(f"_last.{new}")).otherwise(F.col(old)).alias(old)
    return kept.select("ip", pick("attributes", "attributes"), pick("window_count", "request_count"), pick("t", "since"))


def transition_store(events: DataFrame) -> DataFrame:
    """The durable state that transitions leave: (shard, hot addresses, next sequence)."""
    last = events.groupBy("shard", "ip").agg(F.max_by("type", "sequence").alias("_type"))
    hot = last.groupBy("shard").agg(F.count_if(F.col("_type") == "HotIpAdded").alias("hot_ips"))
    return hot.join(events.groupBy("shard").agg((F.max("sequence") + 1).alias("next_sequence")), "shard")


def without_repeats(rows: DataFrame, seconds: int = DUPLICATE_WINDOW_SECONDS) -> DataFrame:
    """Rows (message_id, published_at, position) without those whose message_id was taken less than ``seconds`` before; a repeat does not extend that."""
    claimed = claims(rows.select("message_id", F.col("published_at").alias("t"), F.col("position").alias("id")), seconds, ("message_id",))
    return claimed.where("claimed").select("message_id", F.col("t").alias("published_at"), F.col("id").alias("position"))


def key_id(key: bytes, label: bytes = b"agent-token-key-id") -> str:
    """Tells keys apart without showing them."""
    return hmac.new(key, label, hashlib.sha256).hexdigest()[:16]


#: The fields of a registry document and of an agent in it.
REGISTRY_FIELDS, AGENT_FIELDS = {"registry_version", "hash_algorithm", "key_id", "agents"}, {"token_hash", "previous_token_hash", "previous_token_expires_at", "enabled", "rate_limit_rps"}


def agent_registry(spark: SparkSession, document: dict, key: bytes) -> DataFrame:
    """A versioned registry as a dimension (agent_id, token_hash, previous_token_hash, previous_expires_at in seconds, enabled, rate_limit_rps); a document that breaks a rule is an error."""
    wants = {"registry_version": 2, "hash_algorithm": "hmac-sha256", "key_id": key_id(key)}
    if not isinstance(document, dict) or any(document.get(k) != v for k, v in wants.items()) or not isinstance(document.get("agents"), dict) or set(document) - REGISTRY_FIELDS:
        raise ValueError("the registry's version, algorithm, key or fields are not the expected ones")
    rows, held = [], {}
    for name, agent in document["agents"].items():
        if not isinstance(agent, dict) or set(agent) - AGENT_FIELDS or "token_hash" not in agent:
            raise ValueError(f"{name}: fields")
        former, until = agent.get("previous_token_hash"), agent.get("previous_token_expires_at")
        rate, enabled = agent.get("rate_limit_rps"), agent.get("enabled", True)
        if (former is None) != (until is None) or former == agent["token_hash"] or not isinstance(enabled, bool) or rate is not None and (not isinstance(rate, int) or isinstance(rate, bool) or rate <= 0):
            raise ValueError(f"{name}: a former token needs an end and another hash, enabled a boolean, the rate a positive integer")
        at = datetime.fromisoformat(until) if until is not None else None
        if at is not None and at.tzinfo is None:
            raise ValueError(f"{name}: the end of the former token needs an offset")
        for value in filter(None, (agent["token_hash"], former)):
            if not re.fullmatch("[0-9a-fA-F]{64}", value) or held.setdefault(value.lower(), name) != name:
                raise ValueError(f"{name}: not a hash, or one that {held.get(value.lower())} has")
        rows.append((name, agent["token_hash"].lower(), former and former.lower(), int(at.timestamp()) if at else None, enabled, rate))
    return spark.createDataFrame(rows, "agent_id string, token_hash string, previous_token_hash string, previous_expires_at long, enabled boolean, rate_limit_rps int")


def load_agents(spark: SparkSession, path: str, key: bytes) -> DataFrame:
    """``agent_registry`` of a JSON file; a repeated key is an error."""

    def unique(pairs: list[tuple[str, object]]) -> dict:
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError("repeated key")
        return dict(pairs)

    with open(path, encoding="utf-8") as f:
        return agent_registry(spark, json.load(f, object_pairs_hook=unique), key)


def read_observations(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Agents' messages from JSON lines, batch or stream, with an explicit schema; what does not parse is in ``corrupt``."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(f"{OBSERVATION_PAYLOAD}, corrupt string").option("columnNameOfCorruptRecord", "corrupt").json(path)


def subject_of(topic: str, partition: Column) -> Column:
    return F.concat(F.lit(f"{topic}."), partition.cast("string"))


def partition_of(topic: str, subject: Column) -> Column:
    """The partition that a subject ``<topic>.<n>`` names; null if it is not written so or there is no such partition."""
    number = F.regexp_extract(subject, rf"^{topic}\.(0|[1-9][0-9]*)$", 1)
    value = F.when(F.length(number).between(1, 9), number.cast("int"))
    return F.when(value < TOPICS[topic].partitions, value)


def republished(rows: DataFrame, last_sequence: int | None) -> DataFrame:
    """What a restarted publisher sends again: rows at or after the last sequence known to be published."""
    return rows if last_sequence is None else rows.where(F.col("sequence") >= last_sequence)
