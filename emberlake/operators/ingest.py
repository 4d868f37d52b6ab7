"""The relational part of ingestion: validation, de-duplication, coalescing, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlake.config import DetectionConfig
from emberlake.functions.addressing import is_ipv4

# Limits of an observation message.
MAX_ENTRIES, MAX_BODY, MAX_COUNT, MAX_AGENT, MAX_WINDOW = 10_000, 1 << 20, 1_000_000_000, 128, 3600
#: Sequences whose run is measured together.
SEQUENCE_SPAN = 1 << 16
KEYS = ("agent_id", "sequence", "window_start", "window_seconds", "observations")


def reject_reason(cfg: DetectionConfig, valid_ip=is_ipv4, raw: Column | None = None) -> Column:
    """Why a message (agent_id, sequence, window_start in microseconds, window_seconds, observations) is refused; null if it is not.

    With its ``raw`` text, a body over the limit and keys that no message has are refused first.
    """
    obs = F.col("observations")
    first = F.when(body_too_large(raw), "body").when(F.size(unknown_keys(raw)) > 0, "unknown_key") if raw is not None else F
    return (
        first.when(F.length("agent_id").between(1, MAX_AGENT).isNull() | ~F.length("agent_id").between(1, MAX_AGENT), "agent_id")
        .when(F.col("sequence").isNull() | (F.col("sequence") < 0), "sequence")
        .when(F.col("window_seconds").isNull() | ~F.col("window_seconds").between(1, MAX_WINDOW), "window_seconds")
        .when(F.col("window_start").isNull() | (F.pmod("window_start", F.lit(cfg.bucket_seconds * 1_000_000)) != 0), "misaligned")
        .when(obs.isNull() | (F.size(obs) < 1), "empty")
        .when(F.size(obs) > MAX_ENTRIES, "too_many")
        .when(F.exists(obs, lambda o: F.coalesce(~o["request_count"].between(0, MAX_COUNT), F.lit(True))), "request_count")
        .when(F.exists(obs, lambda o: ~valid_ip(o["ip"])), "ip")
    )


def unknown_keys(raw: Column) -> Column:
    """Top-level keys that no observation message has."""
    return F.array_except(F.json_object_keys(raw), F.array(*map(F.lit, KEYS)))


def body_too_large(raw: Column, limit: int = MAX_BODY) -> Column:
    return F.octet_length(raw) > limit


def authenticated(messages: DataFrame, agents: DataFrame) -> DataFrame:
    """Adds auth: ok, unknown, disabled or mismatch. ``agents`` is a small registry (agent_id, enabled)."""
    known = agents.select(F.col("agent_id").alias("_agent"), F.col("enabled").alias("_enabled"))
    joined = messages.join(known, F.col("authenticated_as") == F.col("_agent"), "left")
    auth = F.when(F.col("_agent").isNull(), "unknown").when(~F.col("_enabled"), "disabled").when(F.col("agent_id") != F.col("authenticated_as"), "mismatch").otherwise("ok")
    return joined.withColumn("auth", auth).drop("_agent", "_enabled")


def token_holders(calls: DataFrame, agents: DataFrame) -> DataFrame:
    """Adds authenticated_as and auth (ok, unknown, disabled) to calls (token_hash, now): the agent whose token it is, or was until it ended."""
    own = agents.select(F.col("agent_id").alias("authenticated_as"), "enabled", F.col("token_hash").alias("_hash"), F.lit(None).cast("long").alias("_until"))
    former = agents.where("previous_token_hash is not null").select(F.col("agent_id").alias("authenticated_as"), "enabled", F.col("previous_token_hash").alias("_hash"), F.col("previous_expires_at").alias("_until"))
    held = calls.join(own.union(former), (F.col("token_hash") == F.col("_hash")) & (F.col("_until").isNull() | (F.col("now") < F.col("_until"))), "left")
    return held.withColumn("auth", F.when(F.col("_hash").isNull(), "unknown").when(~F.col("enabled"), "disabled").otherwise("ok")).drop("_hash", "_until", "enabled")


def first_seen(messages: DataFrame, order: str) -> DataFrame:
    """One row for each (agent_id, sequence): the first by ``order``."""
    nth = F.row_number().over(Window.partitionBy("agent_id", "sequence").orderBy(order))
    return messages.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def unseen(messages: DataFrame, seen: DataFrame) -> DataFrame:
    """Messages that no earlier batch claimed."""
    return messages.join(seen.select("agent_id", "sequence").distinct(), ["agent_id", "sequence"], "left_anti")


def high_water_marks(messages: DataFrame, span: int = SEQUENCE_SPAN) -> DataFrame:
    """(agent_id, mark, ahead): the end of the unbroken run of sequences from 0, -1 where 0 is missing, and how many lie beyond it.

    Runs are measured within spans of sequences; an agent's spans, one row each, then
    tell how far the run goes.
    """
    rows = messages.where("sequence >= 0").select("agent_id", "sequence").distinct().withColumn("_span", F.floor(F.col("sequence") / span))
    nth = F.row_number().over(Window.partitionBy("agent_id", "_span").orderBy("sequence")) - 1
    runs = rows.withColumn("_unbroken", F.col("sequence") - F.col("_span") * span == nth)
    spans = runs.groupBy("agent_id", "_span").agg(F.count_if("_unbroken").alias("_run"), F.count("*").alias("_size"))
    order = Window.partitionBy("agent_id").orderBy("_span")
    full = F.min((F.col("_run") == span).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    reached = spans.withColumn("_reached", (F.coalesce(full, F.lit(1)) == 1) & (F.row_number().over(order) - 1 == F.col("_span")))
    run = F.sum(F.when(F.col("_reached"), F.col("_run")).otherwise(0))
    return reached.groupBy("agent_id").agg((run - 1).alias("mark"), (F.sum("_size") - run).alias("ahead"))


def coalesced(batches: DataFrame, message: tuple[str, ...] = ("agent_id", "batch")) -> DataFrame:
    """(message, ip, request_count): counts of one address in one message added, zeros dropped; a message with a sum over the limit goes whole."""
    sums = batches.groupBy(*message, "ip").agg(F.sum("request_count").alias("request_count"))
    over = F.max("request_count").over(Window.partitionBy(*message))
    return sums.withColumn("_largest", over).where(F.col("_largest") <= MAX_COUNT).where("request_count > 0").drop("_largest")


def batch_cost(batches: DataFrame, message: tuple[str, ...] = ("agent_id", "batch")) -> DataFrame:
    """What a message is charged: its distinct addresses, zeros included."""
    return batches.groupBy(*message).agg(F.count_distinct("ip").alias("cost"))


def retry_after(cost: Column, tokens: Column, rate: float) -> Column:
    """Seconds until a rejected call could pass, one at least."""
    return F.greatest(F.lit(1), F.ceil((cost - tokens) / F.lit(rate)).cast("int"))
