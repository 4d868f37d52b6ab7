"""Queries over messages and logs: codecs, filters, keyed publishing, tokens and throttling keys, the stream's sinks; each beside its SQL."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlake.functions import addressing as A
from emberlake.functions import hashing as H
from emberlake.functions import timebuckets as B
from emberlake.operators import activity, folds, ingest
from emberlake.plans import sql as S
from emberlake.sources import codec
from emberlake.sources import derived as D
from emberlake.sources import log as logs
from emberlake.sources.schemas import HOT_IP_PAYLOAD, OBSERVATION_PAYLOAD, TOPICS
from emberlake.streaming import activity_stream

#: A key for the keyed hashes of the test rows.
KEY = b"test-key"
_HASH_TOPIC = "hot-ip"


def _k(n: int):
    return F.col("sequence") % n


def _observation_events(spark: SparkSession, d: str) -> DataFrame:
    """Encoded observation events; of ten, one each is damaged in another way."""
    o = D.observations(spark, d).withColumn("config_version", F.lit(1)).withColumn("ip_text", A.format_ipv4(F.col("ip")))
    entry = F.struct(F.col("ip_text").alias("ip"), "request_count")
    o = o.withColumn("timestamp", B.format_rfc3339(F.timestamp_seconds("t"))).withColumn("window_start", F.col("timestamp")).withColumn("window_seconds", F.lit(3600))
    o = o.withColumn("observations", F.when(_k(20) == 8, F.array(entry, entry)).otherwise(F.array(entry)))
    rows = codec.encode(o, "RequestObservation", ["agent_id", "sequence", "window_start", "window_seconds", "observations"], F.col("ip_text"))
    value = F.col("value")
    damaged = (
        F.when(_k(10) == 1, F.replace(value, F.col("event_id"), F.lit("0" * 64)))
        .when(_k(10) == 2, F.replace(value, F.lit('"schema_version":1'), F.lit('"schema_version":2')))
        .when(_k(10) == 3, F.left(value, F.length(value) - 1))
        .when(_k(10) == 4, F.replace(value, F.lit('"event_type":"RequestObservation"'), F.lit('"event_type":"Other"')))
        .when(_k(10) == 5, F.replace(value, F.concat(F.lit('"timestamp":"'), F.col("timestamp"), F.lit('","schema')), F.lit('"timestamp":"soon","schema')))
        .when(_k(10) == 6, F.replace(value, F.lit('"schema_version":1'), F.lit('"schema_version":1.0')))
        .otherwise(value)
    )
    key = F.when(_k(20) == 7, "0.0.0.0").otherwise(F.col("ip_text"))
    return rows.select(F.col("sequence").alias("offset"), key.alias("key"), damaged.alias("value"))


def observation_messages(spark, d):
    rows = codec.decode(_observation_events(spark, d), "RequestObservation", OBSERVATION_PAYLOAD)
    problem = F.coalesce("problem", codec.observation_problem())
    entry = F.col("payload.observations")[0]
    return rows.select("offset", problem.alias("problem"), F.when(problem.isNull(), F.col("agent_id")).alias("agent_id"), F.when(problem.isNull(), entry["ip"]).alias("ip"), F.when(problem.isNull(), entry["request_count"]).alias("request_count"))


def hot_ip_messages(spark, d):
    o = D.observations(spark, d).withColumn("config_version", F.lit(1)).withColumn("timestamp", B.format_rfc3339(F.timestamp_seconds("t")))
    o = o.withColumn("ip", F.when(_k(8) == 1, F.concat(F.lit("2001:db8::"), F.lower(F.hex(_k(60000) + 1)))).otherwise(A.format_ipv4(F.col("ip"))))
    o = o.withColumn("type", F.when(_k(8) == 2, "HotIpMoved").otherwise("HotIpAdded"))
    rows = codec.encode(o, "HotIpAdded", ["type", "ip", "timestamp", "sequence", "config_version"], F.col("ip"))
    log = rows.select(F.col("sequence").alias("offset"), F.when(_k(8) == 3, F.lit("1.1.1.1")).otherwise(F.col("ip")).alias("key"), "value")
    read = codec.decode(log, "HotIpAdded", HOT_IP_PAYLOAD)
    return read.select("offset", F.coalesce("problem", codec.hot_ip_problem(("ipv4",))).alias("problem"))


def message_bodies(spark, d):
    o = D.observations(spark, d)
    raw = F.concat(F.lit('{"agent_id":"'), F.col("agent_id"), F.lit('","sequence":'), F.col("sequence").cast("string"), F.when(_k(5) == 0, ',"extra":{"sequence":1}').otherwise(""), F.when(_k(7) == 0, ',"Sequence":"é"').otherwise(""), F.lit("}"))
    return o.select("sequence", F.array_join(ingest.unknown_keys(raw), ",").alias("unknown"), ingest.body_too_large(raw, 60).alias("too_large"))


def observation_files(spark, d):
    """Messages written as JSON lines and read by the file source; one of nine lines is cut short."""
    from emberlake.streaming.activity_stream import shared_folder

    o = D.observations(spark, d)
    body = F.to_json(F.struct("agent_id", "sequence", F.lit("2027-01-15T08:00:00Z").alias("window_start"), F.lit(3600).alias("window_seconds"), F.array(F.struct(A.format_ipv4(F.col("ip")).alias("ip"), "request_count")).alias("observations")))
    path = f"{shared_folder(spark)}/messages"
    o.select(F.when(_k(9) == 4, F.left(body, F.length(body) - 3)).otherwise(body).alias("value")).write.text(path)
    read = logs.read_observations(spark, path)
    whole = F.col("corrupt").isNull()
    return read.select(F.when(whole, F.col("sequence")).alias("sequence"), F.when(whole, F.col("observations")[0]["request_count"]).alias("request_count"), (~whole).alias("broken"))


def _published(spark, d) -> DataFrame:
    """A log written in two goes; a third of the first go's messages comes again in the second."""
    path = f"{activity_stream.shared_folder(spark)}/log"
    o = D.observations(spark, d)
    rows = o.select(A.format_ipv4(F.col("ip")).alias("key"), F.concat(F.lit("m"), F.col("sequence").cast("string")).alias("message_id"), F.col("agent_id").alias("value"), F.col("sequence").alias("position"))
    first, later = rows.where("position % 2 = 0"), rows.where("position % 2 = 1")
    logs.publish(spark, path, _HASH_TOPIC, first.unionByName(first.where("position % 4 = 0").withColumn("position", F.col("position") + 10_000_000)))
    logs.publish(spark, path, _HASH_TOPIC, later.unionByName(first.where("position % 3 = 0")))
    return logs.provision(spark, path)


def published_log(spark, d):
    return _published(spark, d).select("partition", "offset", "key", "message_id", logs.subject_of(_HASH_TOPIC, F.col("partition")).alias("subject"))


def log_bounds(spark, d):
    return logs.bounds(_published(spark, d))


def log_replay(spark, d):
    return logs.replay(_published(spark, d), 20).select("partition", "offset", "message_id")


def log_unhandled(spark, d):
    log = _published(spark, d)
    half = logs.bounds(log).where("partition % 5 != 0").select("partition", F.floor(F.col("end_offset") / 2).alias("position"))
    return logs.unhandled(log.unionByName(log.where("offset % 3 = 0")), half).select("partition", "offset", "message_id")


def log_duplicate_window(spark, d):
    o = D.observations(spark, d)
    rows = o.select(F.concat(F.lit("m"), F.floor(F.col("sequence") / 3).cast("string")).alias("message_id"), (F.col("sequence") * 47).alias("published_at"), F.col("sequence").alias("position"))
    return logs.without_repeats(rows)


def republished(spark, d):
    return logs.republished(D.observations(spark, d).select("agent_id", "sequence"), 700)


def json_integers(spark, d):
    e = D.observations(spark, d)
    n = F.col("sequence").cast("string")
    raw = F.concat(F.lit('{"n": '), F.when(_k(6) == 1, F.concat(n, F.lit(".0"))).when(_k(6) == 2, F.concat(F.lit('"'), n, F.lit('"'))).when(_k(6) == 3, "true").when(_k(6) == 4, F.concat(n, F.lit(".5"))).when(_k(6) == 5, F.concat(F.lit("-"), n)).otherwise(n), F.lit("}"))
    text = F.when(_k(4) == 0, F.concat(F.lit("0"), n)).when(_k(4) == 1, F.concat(F.lit("-"), n)).otherwise(n)
    return e.select("sequence", codec.json_integer(raw, "$.n").alias("n"), codec.decimal_text(text).alias("is_decimal"))


def timestamps_text(spark, d):
    e = D.observations(spark, d).withColumn("at", F.date_format(F.timestamp_seconds("t"), "yyyy-MM-dd'T'HH:mm:ss"))
    text = F.when(_k(5) == 0, F.concat("at", F.lit("Z"))).when(_k(5) == 1, F.concat("at", F.lit("+02:00"))).when(_k(5) == 2, F.concat("at", F.lit(".250Z"))).when(_k(5) == 3, F.lit("later")).otherwise(F.col("at"))
    return e.select("sequence", B.format_rfc3339(B.parse_rfc3339(text)).alias("read"))


def keyed_hashes(spark, d):
    names = D.observations(spark, d).select(F.concat("agent_id", F.lit("-"), (_k(50)).cast("string")).alias("name"), "sequence")
    return names.select("sequence", H.dedup_key(F.col("name"), F.col("sequence")).alias("dedup_key"), H.keyed_hash(KEY)(F.col("name")).alias("hash"), H.agent_slot(KEY)(F.col("name")).alias("slot"))


def client_keys(spark, d):
    o = D.observations(spark, d).withColumn("text", A.format_ipv4(F.col("ip")))
    client = F.when(_k(4) == 1, F.concat(F.lit("::ffff:"), F.col("text"))).when(_k(4) == 2, F.concat(F.lit("2001:db8:0:1::"), F.lower(F.hex(_k(60000) + 1)))).when(_k(4) == 3, F.lit("nobody")).otherwise(F.col("text"))
    header = F.when(_k(3) == 0, F.concat(F.col("text"), F.lit(", 10.0.0.1 ,10.0.0.2"))).when(_k(3) == 1, F.concat(F.lit("unknown, "), F.col("text"))).otherwise(F.lit("10.0.0.2"))
    return o.select("sequence", A.source_key(client).alias("source"), A.forwarded_client(header, 2).alias("client"))


def agent_tokens(spark, d):
    """Calls with tokens of their own, former, expired and unknown ones, against the registry of their agents."""
    digest = lambda text: hmac.new(KEY, text.encode(), hashlib.sha256).hexdigest()
    names = ["click", "error", "purchase", "signup", "view"]
    registry = {"registry_version": 2, "hash_algorithm": "hmac-sha256", "key_id": logs.key_id(KEY), "agents": {n: {"token_hash": digest(f"{n}-new"), "enabled": n != "purchase", "previous_token_hash": digest(f"{n}-old"), "previous_token_expires_at": "2024-01-20T00:00:00+00:00" if n != "click" else "2024-01-05T00:00:00Z"} for n in names}}
    agents = logs.agent_registry(spark, registry, KEY)
    o = D.observations(spark, d)
    token = F.concat("agent_id", F.when(_k(3) == 0, "-new").when(_k(3) == 1, "-old").otherwise("-lost"))
    calls = o.select("sequence", token.alias("token"), F.lit(1705276800).cast("long").alias("now"))
    return ingest.token_holders(calls.withColumn("token_hash", H.keyed_hash(KEY)(F.col("token"))), agents).select("sequence", "authenticated_as", "auth")


def event_parameters(spark, d):
    from emberlake.plans import catalogue as C

    changed = activity.edges(activity.reevaluated(C._buckets(spark, d), C.CFG, C.NEW, C.CHANGE_AT))
    configs = spark.createDataFrame([(1, C.CFG.hot_threshold), (2, C.NEW.hot_threshold)], "config_version int, hot_threshold int")
    return activity.with_config(changed.select("ip", "t", "phase", "state", "config_version"), configs)


def emitted_once(spark, d):
    """Batches of a stream, one of them repeated, each with a key of the one before."""
    path = f"{activity_stream.shared_folder(spark)}/sink"
    o = D.observations(spark, d).select("sequence", "agent_id")
    write = activity_stream.idempotent_sink(path, "sequence")
    for number, part in ((0, "sequence % 3 = 0"), (1, "sequence % 3 = 1 or sequence % 6 = 0"), (1, "sequence % 3 = 1 or sequence % 6 = 0"), (2, "sequence % 3 = 2 or sequence % 2 = 0")):
        write(o.where(part), number)
    return spark.read.parquet(path).select("sequence", "agent_id", F.col("batch").cast("int").alias("batch"))


def materialised_view(spark, d):
    return activity_stream.view_of_stored(spark, d)


NAMES = (
    "observation_messages hot_ip_messages message_bodies observation_files published_log log_bounds log_replay log_unhandled log_duplicate_window republished json_integers timestamps_text keyed_hashes client_keys agent_tokens event_parameters emitted_once materialised_view"
).split()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: globals()[name] for name in NAMES}


_KEY_PAD = KEY.ljust(64, b"\0")
_MAC = lambda x: f"sha256(unhex('{bytes(c ^ 0x5C for c in _KEY_PAD).hex()}') || unhex(sha256(unhex('{bytes(c ^ 0x36 for c in _KEY_PAD).hex()}') || encode({x}))))"
_PUBLISHED = f"""keyed AS (SELECT {S._IP('ip')} AS key, 'm' || sequence AS message_id, agent_id AS value, sequence FROM obs),
placed AS (SELECT *, CAST(list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split(key, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, b: (xor(h, b) * 16777619) & 4294967295) % {TOPICS[_HASH_TOPIC].partitions} AS INTEGER) AS partition FROM keyed),
log AS (SELECT *, row_number() OVER (PARTITION BY partition ORDER BY sequence % 2, sequence) - 1 AS "offset" FROM placed)"""
_O = S._OBS

SQL: dict[str, str] = {
    "observation_messages": S._q(f"""SELECT "offset", problem, CASE WHEN problem IS NULL THEN agent_id END AS agent_id, CASE WHEN problem IS NULL THEN {S._IP('ip')} END AS ip, CASE WHEN problem IS NULL THEN request_count END AS request_count FROM
      (SELECT *, sequence AS "offset", CASE sequence % 10 WHEN 1 THEN 'event_id' WHEN 2 THEN 'schema_version' WHEN 3 THEN 'json' WHEN 4 THEN 'event_type' WHEN 5 THEN 'timestamp' ELSE
       CASE sequence % 20 WHEN 8 THEN 'entries' WHEN 7 THEN 'key' END END AS problem FROM obs)""", _O),
    "hot_ip_messages": S._q("""SELECT sequence AS "offset", CASE sequence % 8 WHEN 1 THEN 'family' WHEN 2 THEN 'type' WHEN 3 THEN 'key' END AS problem FROM obs""", _O),
    "message_bodies": S._q("""SELECT sequence, CASE WHEN sequence % 35 = 0 THEN 'extra,Sequence' WHEN sequence % 5 = 0 THEN 'extra' WHEN sequence % 7 = 0 THEN 'Sequence' ELSE '' END AS unknown,
      27 + length(agent_id) + length(sequence::VARCHAR) + CASE WHEN sequence % 5 = 0 THEN 23 ELSE 0 END + CASE WHEN sequence % 7 = 0 THEN 16 ELSE 0 END > 60 AS too_large FROM obs""", _O),
    "observation_files": S._q("SELECT CASE WHEN sequence % 9 <> 4 THEN sequence END AS sequence, CASE WHEN sequence % 9 <> 4 THEN request_count END AS request_count, sequence % 9 = 4 AS broken FROM obs", _O),
    "published_log": S._q("""SELECT partition, "offset", key, message_id, 'hot-ip.' || partition AS subject FROM log""", _O, _PUBLISHED),
    "log_bounds": S._q("""SELECT partition, min("offset") AS first_offset, max("offset") + 1 AS end_offset, arg_max(value, "offset") AS last_value FROM log GROUP BY partition""", _O, _PUBLISHED),
    "log_replay": S._q("""SELECT partition, "offset", message_id FROM log WHERE "offset" >= 20""", _O, _PUBLISHED),
    "log_unhandled": S._q("""SELECT partition, "offset", message_id FROM (SELECT *, count(*) OVER (PARTITION BY partition) AS n FROM log) WHERE partition % 5 = 0 OR "offset" >= n // 2""", _O, _PUBLISHED),
    "log_duplicate_window": f"""WITH RECURSIVE {_O}, n AS (SELECT 'm' || (sequence // 3) AS message_id, sequence * 47 AS published_at, sequence AS position, row_number() OVER (PARTITION BY sequence // 3 ORDER BY sequence) AS k FROM obs),
      f AS (SELECT message_id, published_at, position, k, true AS kept, published_at + 120 AS until FROM n WHERE k = 1
        UNION ALL SELECT n.message_id, n.published_at, n.position, n.k, n.published_at >= f.until, CASE WHEN n.published_at >= f.until THEN n.published_at + 120 ELSE f.until END FROM f JOIN n ON n.message_id = f.message_id AND n.k = f.k + 1)
      SELECT message_id, published_at, position FROM f WHERE kept""",
    "republished": S._q("SELECT agent_id, sequence FROM obs WHERE sequence >= 700", _O),
    "json_integers": S._q("""SELECT sequence, CASE sequence % 6 WHEN 0 THEN sequence WHEN 1 THEN sequence WHEN 5 THEN -sequence END AS n, CASE sequence % 4 WHEN 0 THEN false WHEN 1 THEN false ELSE true END AS is_decimal FROM obs""", _O),
    "timestamps_text": S._q("""SELECT sequence, CASE sequence % 5 WHEN 1 THEN strftime(to_timestamp(t - 7200) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') WHEN 2 THEN strftime(to_timestamp(t) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S.250000Z')
      WHEN 3 THEN NULL ELSE strftime(to_timestamp(t) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') END AS read FROM obs""", _O),
    "keyed_hashes": S._q(f"""SELECT sequence, name || chr(31) || sequence AS dedup_key, hash, CAST(('0x' || right(hash, 3))::INTEGER AS INTEGER) AS slot FROM (SELECT sequence, name, {_MAC('name')} AS hash FROM (SELECT sequence, agent_id || '-' || (sequence % 50) AS name FROM obs))""", _O),
    "client_keys": S._q(f"""SELECT sequence, CASE sequence % 4 WHEN 2 THEN '2001:db8:0:1::/64' WHEN 3 THEN NULL ELSE text || '/32' END AS source, CASE sequence % 3 WHEN 0 THEN '10.0.0.1' END AS client FROM (SELECT sequence, {S._IP('ip')} AS text FROM obs)""", _O),
    "agent_tokens": S._q("""SELECT sequence, CASE WHEN found THEN agent_id END AS authenticated_as, CASE WHEN NOT found THEN 'unknown' WHEN agent_id = 'purchase' THEN 'disabled' ELSE 'ok' END AS auth FROM
      (SELECT *, sequence % 3 = 0 OR (sequence % 3 = 1 AND agent_id <> 'click') AS found FROM obs)""", _O),
    "event_parameters": S._q("SELECT ip, t, phase, state, CASE WHEN is_new THEN 2 ELSE 1 END AS config_version, CASE WHEN is_new THEN 150 ELSE 200 END AS hot_threshold FROM new_edges", *S._B, S._TICKS, S._CHANGED),
    "emitted_once": S._q("SELECT sequence, agent_id, CAST(sequence % 3 AS INTEGER) AS batch FROM obs", _O),
    "materialised_view": S._q("SELECT length, network, hot_count FROM last_rows", *S._L),
}
