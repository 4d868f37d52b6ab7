"""From observations to hot-address events: buckets, sliding sums, hysteresis, edges.

Every operator takes and returns DataFrames. All windows are partitioned by address
(or shard) after pre-aggregation to one row for each address and bucket, so an
address that sends a third of all observations still has few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlake.config import DetectionConfig
from emberlake.functions.hashing import event_id
from emberlake.functions.timebuckets import is_live, within_lateness
from emberlake.functions.weights import threshold_ratio, transition_attributes
from emberlake.operators.ordering import numbered


def lateness_outcome(now: Column, start: Column, window_seconds: Column, cfg: DetectionConfig) -> Column:
    """What becomes of an observation, by the first rule that fits: window_too_long, future, late, expired_bucket, applied."""
    bucket = start - F.pmod(start, F.lit(cfg.bucket_seconds).cast("long"))
    return (
        F.when(window_seconds > cfg.window_seconds, "window_too_long")
        .when(start > now, "future")
        .when(~within_lateness(now, start, cfg.window_seconds, cfg.allowed_lateness_seconds), "late")
        .when(~is_live(now, bucket, cfg.window_seconds, cfg.bucket_seconds), "expired_bucket")
        .otherwise("applied")
    )


def split_outcomes(classified: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Applied rows, and the side output of all others, unchanged."""
    return classified.where("outcome = 'applied'"), classified.where("outcome != 'applied'")


def bucket_counts(obs: DataFrame) -> DataFrame:
    """(ip, bucket, requests): all deltas of a bucket added, zeros left out."""
    return obs.where("request_count > 0").groupBy("ip", "bucket").agg(F.sum("request_count").alias("requests"))


def sliding_totals(buckets: DataFrame, cfg: DetectionConfig) -> DataFrame:
    """The total over live buckets at each bucket of an address."""
    live = Window.partitionBy("ip").orderBy("bucket").rangeBetween(-(cfg.window_seconds - cfg.bucket_seconds), 0)
    return buckets.withColumn("total", F.sum("requests").over(live))


def window_ticks(buckets: DataFrame, cfg: DetectionConfig) -> DataFrame:
    """Every moment an address's total changes: (ip, t, phase, delta, total).

    A bucket adds its requests when it starts (phase 1) and takes them away a window
    later (phase 0). At one instant what expires goes first.
    """
    arrive = buckets.select("ip", F.col("bucket").alias("t"), F.lit(1).alias("phase"), F.col("requests").alias("delta"))
    expire = buckets.select("ip", (F.col("bucket") + cfg.window_seconds).alias("t"), F.lit(0).alias("phase"), (-F.col("requests")).alias("delta"))
    order = Window.partitionBy("ip").orderBy("t", "phase").rowsBetween(Window.unboundedPreceding, 0)
    return arrive.union(expire).withColumn("total", F.sum("delta").over(order))


def hysteresis(ticks: DataFrame, hot: Column, cold: Column, order: tuple[str, ...] = ("t", "phase"), exempt: Column | None = None, initial: Column | None = None) -> DataFrame:
    """Adds state, 1 for HOT and 0 for COLD, to ticks with a total.

    HOT from ``hot`` on, COLD below ``cold``, unchanged between: the last decided value
    stands. As cold < hot the two never both decide. Thresholds may differ by row (after
    a change of parameters); rows where ``exempt`` holds (a warm-up) never turn COLD.
    """
    so_far = Window.partitionBy("ip").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    falls = F.col("total") < cold if exempt is None else (F.col("total") < cold) & ~exempt
    decided = F.when(F.col("total") >= hot, 1).when(falls, 0)
    return ticks.withColumn("state", F.coalesce(F.last(decided, ignorenulls=True).over(so_far), initial if initial is not None else F.lit(0)).cast("int"))


def timeline(buckets: DataFrame, cfg: DetectionConfig) -> DataFrame:
    """(ip, t, phase, delta, total, state)."""
    return hysteresis(window_ticks(buckets, cfg), F.lit(cfg.hot_threshold), F.lit(cfg.cold_threshold))


def edges(states: DataFrame, order: tuple[str, ...] = ("t", "phase"), initial: Column | None = None) -> DataFrame:
    """The rows at which an address's state changes; every address begins COLD, or at ``initial``."""
    before = F.coalesce(F.lag("state").over(Window.partitionBy("ip").orderBy(*order)), initial if initial is not None else F.lit(0))
    return states.withColumn("_before", before).where("state != _before").drop("_before")


def transition_events(changed: DataFrame, cfg: DetectionConfig, shards: int) -> DataFrame:
    """What each edge says, without a number: all that readers of the hot set need."""
    shard = F.pmod(F.col("ip"), F.lit(shards)).cast("int")
    kind = F.when(F.col("state") == 1, "HotIpAdded").otherwise("HotIpRemoved")
    out = changed.select("ip", "t", "phase", shard.alias("shard"), kind.alias("type"), F.col("total").alias("window_count"))
    weight = threshold_ratio(F.col("window_count"), cfg.hot_threshold, cfg.weight_max)
    return (
        out.withColumn("weight", F.when(F.col("type") == "HotIpAdded", weight))
        .withColumn("attributes", F.when(F.col("type") == "HotIpAdded", transition_attributes(weight)))
        .withColumn("config_version", F.lit(cfg.config_version))
    )


def hot_ip_events(changed: DataFrame, cfg: DetectionConfig, shards: int) -> DataFrame:
    """The event of each edge, numbered within its shard."""
    out = numbered(transition_events(changed, cfg, shards), ["shard"], "t", ["t", "phase", "ip"], "sequence")
    return out.withColumn("event_id", event_id(F.concat(F.lit("aggregator-"), F.col("shard").cast("string")), F.col("sequence"), F.col("type"), F.col("ip").cast("string")))


def reevaluated(buckets: DataFrame, old: DetectionConfig, new: DetectionConfig, change_at: Column | int) -> DataFrame:
    """The timeline under a change of thresholds: every tracked address is evaluated again at that moment (phase 2)."""
    change = F.lit(change_at).cast("long") if isinstance(change_at, int) else change_at
    ticks = window_ticks(buckets, old).select("ip", "t", "phase", "delta")
    again = buckets.select("ip").distinct().select("ip", change.alias("t"), F.lit(2).alias("phase"), F.lit(0).cast("long").alias("delta"))
    order = Window.partitionBy("ip").orderBy("t", "phase").rowsBetween(Window.unboundedPreceding, 0)
    both = ticks.union(again).withColumn("total", F.sum("delta").over(order))
    is_new = (F.col("t") > change) | (F.col("t") == change) & (F.col("phase") == 2)
    pick = lambda a, b: F.when(is_new, b).otherwise(a)
    return hysteresis(both, pick(old.hot_threshold, new.hot_threshold), pick(old.cold_threshold, new.cold_threshold)).withColumn("config_version", pick(old.config_version, new.config_version))


def rebucketed(buckets: DataFrame, cfg: DetectionConfig) -> DataFrame:
    """Buckets moved to another geometry."""
    return buckets.withColumn("bucket", F.col("bucket") - F.pmod("bucket", F.lit(cfg.bucket_seconds).cast("long"))).groupBy("ip", "bucket").agg(F.sum("requests").alias("requests"))


def current_states(states: DataFrame, now: Column | int) -> DataFrame:
    """(ip, total, state, last_seen) at a moment. ``now`` may be a column of ``states``."""
    now = F.lit(now).cast("long") if isinstance(now, int) else now
    past = states.where(F.col("t") <= now)
    at = F.struct("t", "phase")
    return past.groupBy("ip").agg(F.max_by("total", at).alias("total"), F.max_by("state", at).alias("state"), F.max(F.when(F.col("phase") == 1, F.col("t"))).alias("last_seen"))


def shard_gauges(states: DataFrame, shards: int) -> DataFrame:
    """tracked, active and hot addresses of each shard."""
    shard = F.pmod(F.col("ip"), F.lit(shards)).cast("int")
    return states.groupBy(shard.alias("shard")).agg(F.count("*").alias("tracked"), F.count_if(F.col("total") > 0).alias("active"), F.count_if(F.col("state") == 1).alias("hot"))


def transition_counters(events: DataFrame) -> DataFrame:
    return events.groupBy("shard", "config_version", "type").agg(F.count("*").alias("events"))


def evictable(states: DataFrame, now: Column, cfg: DetectionConfig) -> DataFrame:
    """COLD addresses idle for the retention period; HOT ones never go."""
    return states.where((F.col("state") == 0) & (now - F.col("last_seen") >= cfg.state_retention_seconds))


def capacity_victims(states: DataFrame, shards: int, keep: int) -> DataFrame:
    """COLD addresses beyond ``keep`` a shard, least recently seen first; ``rank`` counts from the least recent.

    A batch approximation of an ordered store's evictions. Ranks need a shard's COLD
    addresses in one order, so the number of shards bounds what one task sorts.
    """
    shard = F.pmod(F.col("ip"), F.lit(shards)).cast("int")
    sized = states.withColumn("shard", shard).withColumn("_tracked", F.count("*").over(Window.partitionBy("shard")))
    ranked = sized.where("state = 0").withColumn("rank", F.row_number().over(Window.partitionBy("shard").orderBy("last_seen", "ip")))
    return ranked.where(F.col("rank") <= F.col("_tracked") - keep).drop("_tracked")


def with_config(events: DataFrame, configs: DataFrame) -> DataFrame:
    """Each event with the parameters of the version that produced it (config_version, ...), a row for each version."""
    return events.join(configs, "config_version", "left")
