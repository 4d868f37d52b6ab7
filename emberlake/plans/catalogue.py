"""Every registered query over the supplied tables, beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlake import api
from emberlake.config import DetectionConfig, accepted_versions
from emberlake.functions import addressing as A
from emberlake.functions import hashing as H
from emberlake.operators import activity, audit, classify, folds, ingest, metadata, ordering, prefixes
from emberlake.plans import messages
from emberlake.plans import sql as S
from emberlake.sources import derived as D

CFG = D.CONFIG
#: Thresholds after a change of parameters half-way.
NEW = DetectionConfig(config_version=2, window_seconds=CFG.window_seconds, bucket_seconds=CFG.bucket_seconds, hot_threshold=150, cold_threshold=100, state_retention_seconds=CFG.state_retention_seconds, allowed_lateness_seconds=1800)
CHANGE_AT = S.CHANGE_AT
EVENT_ORDER = ("t", "phase")


def _buckets(spark: SparkSession, d: str) -> DataFrame:
    return activity.bucket_counts(D.observations(spark, d))


def _timeline(spark: SparkSession, d: str) -> DataFrame:
    return activity.timeline(_buckets(spark, d), CFG)


def _events(spark: SparkSession, d: str) -> DataFrame:
    return activity.hot_ip_events(activity.edges(_timeline(spark, d)), CFG, D.SHARDS)


def _now(spark: SparkSession, d: str) -> DataFrame:
    return D.observations(spark, d).where("request_count > 0").agg(F.max("bucket").alias("now"))  # one row


def _current(spark: SparkSession, d: str) -> DataFrame:
    states = _timeline(spark, d).crossJoin(F.broadcast(_now(spark, d)))
    return activity.current_states(states, F.col("now"))


def _until_now(events: DataFrame, spark: SparkSession, d: str) -> DataFrame:
    return events.crossJoin(F.broadcast(_now(spark, d))).where("t <= now").drop("now")


def _log(spark: SparkSession, d: str) -> DataFrame:
    """Events up to the last bucket, without numbers."""
    return _until_now(activity.transition_events(activity.edges(_timeline(spark, d)), CFG, D.SHARDS), spark, d)


def _hot(spark: SparkSession, d: str) -> DataFrame:
    return prefixes.hot_set(_log(spark, d))


def _counts(spark: SparkSession, d: str, low: int = 8) -> DataFrame:
    return prefixes.prefix_counts(_hot(spark, d), low)


def _changelog(spark: SparkSession, d: str) -> DataFrame:
    return prefixes.stats_changelog(prefixes.effective_changes(_log(spark, d), EVENT_ORDER))


def _addresses(spark: SparkSession, d: str) -> DataFrame:
    """Observed addresses, and one for each far from any."""
    seen = D.observations(spark, d).select("ip").distinct()
    return seen.union(seen.select((F.col("ip") + 65536 * 100).alias("ip")))


def obs_projection(spark, d):
    return D.observations(spark, d).withColumn("aligned", F.col("t") == F.col("bucket")).withColumn("slot", F.pmod(F.floor(F.col("bucket") / CFG.bucket_seconds), F.lit(CFG.bucket_count)).cast("int"))


def obs_rejects(spark, d):
    o = D.observations(spark, d)
    k = F.col("sequence") % 10
    text = A.format_ipv4(F.col("ip"))
    entry = F.struct(F.when(k == 1, F.concat(text, F.lit(".1"))).when(k == 2, F.concat(F.lit("0"), text)).otherwise(text).alias("ip"), F.when(k == 3, F.lit(-1).cast("long")).when(k == 4, F.lit(1000000001).cast("long")).otherwise(F.col("request_count")).alias("request_count"))
    m = o.select(
        F.when(k == 5, "").otherwise(F.col("agent_id")).alias("agent_id"), "sequence",
        (F.col("bucket") * 1000000 + F.when(k == 6, 1).otherwise(0)).alias("window_start"), F.when(k == 7, 7200).otherwise(3600).alias("window_seconds"),
        F.when(k == 8, F.array().cast("array<struct<ip:string,request_count:bigint>>")).otherwise(F.array(entry)).alias("observations"))
    return m.select("sequence", ingest.reject_reason(CFG).alias("reason"))


def ip_text_roundtrip(spark, d):
    t = D.observations(spark, d).select("ip").distinct().withColumn("text", A.format_ipv4(F.col("ip")))
    return t.withColumn("parsed", A.parse_ipv4(F.col("text"))).withColumn("high_bits", F.array_join(F.slice(A.bits_of(F.col("ip")), 1, 8), ""))


def prefix_text(spark, d):
    p = prefixes.ancestors(D.observations(spark, d).select("ip").distinct(), 8).select("length", "network").distinct()
    return p.select("length", "network", A.format_prefix(F.col("network"), F.col("length")).alias("prefix"), A.capacity(F.col("length")).alias("capacity"), A.capacity_text(F.col("length")).alias("capacity_text"))


def common_prefix_length(spark, d):
    o = D.observations(spark, d)
    other = F.lit(D.BASE_ADDRESS).cast("long") + F.pmod(F.col("sequence") * 7, F.lit(4096))
    return o.select("sequence", "ip", other.alias("other"), A.common_prefix_length(F.col("ip"), other).alias("shared"), A.bit_at(F.col("ip"), 31).alias("last_bit"))


def event_ids(spark, d):
    o = D.observations(spark, d)
    return o.select("sequence", H.event_id(F.col("agent_id"), F.col("sequence"), F.lit("RequestObservation"), A.format_ipv4(F.col("ip"))).alias("event_id"), H.event_id(F.col("agent_id"), F.col("sequence"), F.lit("RequestObservation")).alias("message_event_id"), H.dedup_key(F.col("agent_id"), F.col("sequence")).alias("dedup_key"))


def shard_assignment(spark, d):
    t = D.observations(spark, d).select("ip").distinct().select("ip", A.format_ipv4(F.col("ip")).alias("key"))
    return t.select("ip", "key", H.fnv1a(F.col("key")).alias("hash"), H.partition_for(F.col("key"), 128).alias("partition"))


def _twice(spark, d):
    o = D.observations(spark, d).withColumn("arrival", F.col("sequence"))
    return o.unionByName(o.where("sequence % 10 = 0").withColumn("arrival", F.col("sequence") + 10000000))


def dedup_first(spark, d):
    return ingest.first_seen(_twice(spark, d), "arrival")


def dedup_against_seen(spark, d):
    o = D.observations(spark, d)
    return ingest.unseen(o, o.where("sequence % 3 = 0"))


def dedup_with_ttl(spark, d):
    o = D.observations(spark, d).select("agent_id", "sequence", "t", F.col("sequence").alias("id"))
    again = [o.where(F.col("sequence") % k == 0).select("agent_id", "sequence", (F.col("t") + later).alias("t"), (F.col("id") + n * 10000000).alias("id")) for n, (k, later) in enumerate(((3, 5000), (4, 9000), (6, 12000)), 1)]
    return folds.claims(o.union(again[0]).union(again[1]).union(again[2]), 5400)


def prefix_counts_ipv6(spark, d):
    hot = _hot(spark, d).select(F.lit(2306139568115548160).cast("long").alias("hi"), (F.lit(-(2**63)) + F.col("ip")).alias("lo"))
    return prefixes.prefix_counts_ipv6(hot)


def high_water_mark(spark, d):
    """Each agent's messages numbered from 0, with gaps; one agent begins at 3."""
    own = ordering.numbered(D.observations(spark, d).select("agent_id", "sequence"), ["agent_id"], F.floor(F.col("sequence") / 1000), ["sequence"], "k")
    sent = own.select("agent_id", (F.col("k") + F.when(F.col("agent_id") == "view", 3).otherwise(0)).alias("sequence")).where("sequence % 97 != 50")
    return ingest.high_water_marks(sent.unionByName(sent.where("agent_id = 'click'").select("agent_id", F.lit(0).cast("long").alias("sequence"))), span=64)


def _batches(spark, d):
    return D.observations(spark, d).withColumn("batch", F.floor(F.col("sequence") / 20))


def coalesced_batches(spark, d):
    return ingest.coalesced(_batches(spark, d))


def batch_cost(spark, d):
    return ingest.batch_cost(_batches(spark, d))


def agent_auth(spark, d):
    o = D.observations(spark, d)
    names = o.select("agent_id").distinct().withColumn("enabled", F.col("agent_id") != "purchase").where("agent_id != 'error'")
    return ingest.authenticated(o.select("sequence", "agent_id", F.when(F.col("sequence") % 25 == 0, "view").otherwise(F.col("agent_id")).alias("authenticated_as")), names)


def _classified(spark, d):
    o = D.late_observations(spark, d)
    return o.withColumn("outcome", activity.lateness_outcome(F.col("now"), F.col("t"), F.col("window_seconds"), D.LATE_CONFIG))


def lateness_outcomes(spark, d):
    return _classified(spark, d).select("sequence", "t", "now", "outcome")


def outcome_counts(spark, d):
    return _classified(spark, d).groupBy("outcome").agg(F.count("*").alias("n"))


def reconciliation_rows(spark, d):
    return activity.split_outcomes(_classified(spark, d))[1].select("agent_id", "sequence", "ip", "request_count", "outcome")


def bucket_counts(spark, d):
    return _buckets(spark, d)


def sliding_window_total(spark, d):
    return activity.sliding_totals(_buckets(spark, d), CFG)


def window_ticks(spark, d):
    return activity.window_ticks(_buckets(spark, d), CFG)


def ip_state_timeline(spark, d):
    return _timeline(spark, d)


def ip_transitions(spark, d):
    return activity.edges(_timeline(spark, d)).select("ip", "t", "total", "state")


def hot_ip_events(spark, d):
    return _events(spark, d)


def shard_gauges(spark, d):
    return activity.shard_gauges(_current(spark, d), D.SHARDS)


def transition_counters(spark, d):
    return activity.transition_counters(_events(spark, d))


def transition_store(spark, d):
    from emberlake.sources.log import transition_store as store

    return store(_events(spark, d))


def cold_eviction_candidates(spark, d):
    later = _current(spark, d).crossJoin(F.broadcast(_now(spark, d)))
    return activity.evictable(later, F.col("now") + 300000, CFG).select("ip", "total", "last_seen")


def capacity_victims(spark, d):
    return activity.capacity_victims(_current(spark, d), D.SHARDS, 2).select("shard", "ip", "last_seen", "rank")


def hot_set_current(spark, d):
    return _hot(spark, d)


def request_count_latest(spark, d):
    return api.ip_view(_addresses(spark, d), _hot(spark, d), _counts(spark, d), CFG).select("ip", "state", "request_count")


def attribute_bytes(spark, d):
    return prefixes.attribute_bytes(_hot(spark, d))


def log_positions(spark, d):
    return prefixes.log_position(_until_now(_events(spark, d), spark, d))


def prefix_counts(spark, d):
    return _counts(spark, d, 0)


def prefix_stats(spark, d):
    return classify.with_state(prefixes.with_stats(_counts(spark, d)), CFG)


def prefix_rollup_hierarchical(spark, d):
    hosts = prefixes.prefix_counts(_hot(spark, d), 32)
    c24 = prefixes.rolled_up(hosts, 24)
    c16 = prefixes.rolled_up(c24, 16)
    return c24.unionByName(c16).unionByName(prefixes.rolled_up(c16, 8))


def total_hot(spark, d):
    return prefixes.node_counts(_counts(spark, d, 0), _hot(spark, d))


def prefix_stats_changelog(spark, d):
    return _changelog(spark, d).select("ip", "t", "phase", "length", "network", "delta", "hot_count", "hot_ratio")


def latest_prefix_stats(spark, d):
    return prefixes.latest_stats(_changelog(spark, d))


def hot_prefixes(spark, d):
    return api.hot_prefixes(_hot(spark, d), CFG)


def hot_prefixes_minimal(spark, d):
    return api.hot_prefixes(_hot(spark, d), CFG, only_minimal=True)


def classification_changes(spark, d):
    return classify.classification_changes(_changelog(spark, d), CFG).select("length", "network", "t", "phase", "ip", "hot_count", "state")


def detections_since(spark, d):
    return api.current_detections(_changelog(spark, d), CFG).select("position", "prefix", "hot_count", "capacity", "hot_ratio", "since", "state")


def detection_gauges(spark, d):
    log = _changelog(spark, d)
    return classify.detection_gauges(classify.detections(log, CFG), classify.classification_changes(log, CFG))


def ancestor_counts(spark, d):
    return prefixes.ancestor_counts(_addresses(spark, d), _counts(spark, d, 0)).select("ip", "length", "network", "hot_count")


def longest_match(spark, d):
    return prefixes.longest_match(_addresses(spark, d), _counts(spark, d, 0))


def prefix_containment(spark, d):
    return D.observations(spark, d).where(A.contains(F.lit(D.BASE_ADDRESS + 16).cast("long"), F.lit(28), F.col("ip"))).select("sequence", "ip")


def ip_view(spark, d):
    v = api.ip_view(_addresses(spark, d), _hot(spark, d), _counts(spark, d), CFG)
    return v.select("ip", "address", "state", "request_count", "attributes", F.array_join(F.transform("matched_prefixes", lambda p: F.concat_ws(":", p["prefix"], p["hot_ips"].cast("string"), p["state"])), ",").alias("matched"))


def prefix_view(spark, d):
    asked = prefixes.ancestors(_addresses(spark, d), 8).select("length", "network").distinct()
    return api.prefix_view(asked, _counts(spark, d), CFG)


def _flat(df: DataFrame) -> DataFrame:
    return df.withColumn("tags", F.array_join("tags", ","))


def metadata_local(spark, d):
    asked = D.declarations(spark, d).select("length", "network").distinct()
    return _flat(metadata.local(asked, D.declarations(spark, d)))


def metadata_inherited(spark, d):
    asked = D.declarations(spark, d).select("length", "network").distinct()
    return _flat(metadata.inherited(asked, D.declarations(spark, d)))


def metadata_effective_prefix(spark, d):
    asked = D.declarations(spark, d).select("length", "network").distinct()
    return _flat(metadata.effective_for_prefix(asked, D.declarations(spark, d)))


def metadata_effective(spark, d):
    return _flat(metadata.effective(_addresses(spark, d), D.declarations(spark, d)))


def metadata_conflicts(spark, d):
    return metadata.conflicts(D.declarations(spark, d))


def config_reevaluation(spark, d):
    return activity.edges(activity.reevaluated(_buckets(spark, d), CFG, NEW, CHANGE_AT)).select("ip", "t", "phase", "total", "state", "config_version")


def config_versions(spark, d):
    seen = D.observations(spark, d).select(F.col("sequence").alias("seen_at"), (F.pmod(F.col("sequence") * 37, F.lit(1000)) + F.floor(F.col("sequence") / 500) + 1).alias("config_version"))
    return accepted_versions(seen)


def rebucketed(spark, d):
    wider = DetectionConfig(window_seconds=CFG.window_seconds, bucket_seconds=7200, hot_threshold=200, cold_threshold=120, state_retention_seconds=CFG.state_retention_seconds)
    return activity.rebucketed(_buckets(spark, d), wider)


def warm_up(spark, d):
    until = F.lit(CHANGE_AT).cast("long")
    ticks = activity.window_ticks(_buckets(spark, d), CFG)
    inherited = F.pmod(F.col("ip"), F.lit(3)) == 0
    start = F.when(inherited, 1).otherwise(0)
    states = activity.hysteresis(ticks, F.lit(CFG.hot_threshold), F.lit(CFG.cold_threshold), exempt=inherited & (F.col("t") < until), initial=start)
    return activity.edges(states, initial=start).select("ip", "t", "phase", "total", "state")


def snapshot_plus_tail(spark, d):
    from emberlake.sources.log import resume

    log = _log(spark, d)
    return resume(prefixes.hot_set(log.where(F.col("t") <= CHANGE_AT)), log.where(F.col("t") > CHANGE_AT))


def shard_merge(spark, d):
    hot = _hot(spark, d)
    return prefixes.merged(*(prefixes.prefix_counts(hot.where(F.pmod(F.col("ip"), F.lit(4)) == k)) for k in range(4)))


def rate_limit_decisions(spark, d):
    calls = D.observations(spark, d).select("agent_id", "t", F.col("sequence").alias("id"), (F.col("sequence") % 13 - 1).cast("long").alias("cost"))
    out = folds.token_bucket(calls, 0.002, 10.0)
    return out.select("agent_id", "t", "id", "cost", "allowed", "problem", F.when(~F.col("allowed"), ingest.retry_after(F.col("cost"), F.col("tokens"), 0.002)).alias("retry_after"))


def lease_history(spark, d):
    o = D.observations(spark, d)
    return folds.lease_history(o.select((F.col("ip") % 4).alias("shard"), "t", F.col("sequence").alias("id"), F.col("agent_id").alias("owner"), F.when(F.col("sequence") % 3 == 0, "release").otherwise("acquire").alias("action")), 7200)


def audit_counts(spark, d):
    hot, stored = _hot(spark, d), _counts(spark, d)
    problems = [("counts", audit.count_mismatches(stored, hot)), ("negative", audit.negative_counts(stored)), ("orphans", audit.orphans(stored)), ("hysteresis", audit.hysteresis_violations(_timeline(spark, d), CFG.hot_threshold, CFG.cold_threshold))]
    return _tally(problems)


def audit_records(spark, d):
    records = _hot(spark, d).where("ip % 7 != 0").union(_hot(spark, d).where("ip % 7 = 0").withColumn("ip", F.col("ip") + 1000000))
    return audit.record_mismatches(records, _hot(spark, d))


def _tally(problems: list[tuple[str, DataFrame]]) -> DataFrame:
    rows = [x.agg(F.count("*").alias("violations")).withColumn("check", F.lit(name)) for name, x in problems]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def hot_prefix_walk(spark, d):
    """All prefixes in depth-first order."""
    return prefixes.preorder(_counts(spark, d))


def declarations_order(spark, d):
    order = Window.orderBy("length", "network")  # a row for each declared prefix
    return prefixes.declarations_in_order(D.declarations(spark, d)).withColumn("place", F.row_number().over(order).cast("long"))


def canonical_attributes(spark, d):
    from emberlake.functions.attributes import canonicalize

    e = spark.read.parquet(f"{d}/events.parquet")
    doc = F.concat(F.lit('{ "attributes_version": 1'), F.when(F.col("event_id") % 4 == 0, ".0").otherwise(""), F.lit(', "weight": '), (F.col("event_id") * 300).cast("string"), F.when(F.col("event_id") % 7 == 0, ', "bad": 1').otherwise(', "x_kind": "é"'), F.lit(" }"))
    return e.select("event_id", canonicalize(doc).alias("canonical"))


def stream_equals_batch(spark, d):
    from emberlake.streaming.activity_stream import transitions_of_stored

    return transitions_of_stored(spark, d)


_NAMES = (
    "obs_projection obs_rejects ip_text_roundtrip prefix_text common_prefix_length event_ids shard_assignment dedup_first dedup_against_seen dedup_with_ttl high_water_mark coalesced_batches batch_cost agent_auth lateness_outcomes outcome_counts"
    " reconciliation_rows bucket_counts sliding_window_total window_ticks ip_state_timeline ip_transitions hot_ip_events shard_gauges transition_counters transition_store cold_eviction_candidates capacity_victims hot_set_current"
    " request_count_latest attribute_bytes log_positions prefix_counts prefix_counts_ipv6 prefix_stats prefix_rollup_hierarchical total_hot prefix_stats_changelog latest_prefix_stats hot_prefixes hot_prefixes_minimal classification_changes"
    " detections_since detection_gauges ancestor_counts longest_match prefix_containment ip_view prefix_view metadata_local metadata_inherited metadata_effective_prefix metadata_effective metadata_conflicts config_reevaluation"
    " config_versions rebucketed warm_up snapshot_plus_tail shard_merge rate_limit_decisions lease_history audit_counts audit_records hot_prefix_walk declarations_order canonical_attributes stream_equals_batch"
).split()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: globals()[name] for name in _NAMES} | messages.queries()


def oracle_sql() -> dict[str, str]:
    return S.QUERIES | messages.SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix statistics at the last event time."""
    return prefix_stats(spark, sf_dir)
