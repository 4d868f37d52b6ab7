"""Codecs, logs, registries, attribute documents and keyed hashes."""

import hashlib
import hmac
import json

import pytest
from pyspark.sql import functions as F

from emberlake.functions import hashing as H
from emberlake.functions import timebuckets as B
from emberlake.functions.attributes import canonical, canonicalize, simple_weight
from emberlake.functions.weights import threshold_ratio
from emberlake.sources import codec
from emberlake.sources import log as logs
from emberlake.sources.schemas import LOG, OBSERVATION_PAYLOAD, PREFIX_STATS_PAYLOAD


def rightful(agent, seq, kind, subject=None):
    return hashlib.sha256("\x1f".join([agent, str(seq), kind, *([subject] if subject is not None else [])]).encode()).hexdigest()


def observation(**change):
    body = {"event_id": rightful("a", 1, "RequestObservation", "1.2.3.4"), "agent_id": "a", "sequence": 1, "event_type": "RequestObservation", "config_version": 1, "timestamp": "2027-01-15T08:00:00Z", "schema_version": 1, "subject": "1.2.3.4",
            "payload": {"agent_id": "a", "sequence": 1, "window_start": "2027-01-15T08:00:00Z", "window_seconds": 10, "observations": [{"ip": "1.2.3.4", "request_count": 5}]}}
    return json.dumps(body | change)


def frame(spark, values, key="1.2.3.4"):
    return spark.createDataFrame([("observations", 0, k, key, str(k), v) for k, v in enumerate(values)], LOG)


def test_decode(spark):
    cases = [
        (observation(), None), ("{nope", "json"), (observation(schema_version=2), "schema_version"), (observation(schema_version="1"), "schema_version"), (observation(schema_version=True), "schema_version"),
        (observation(event_type="Other"), "event_type"), (observation(sequence=-1), "identity"), (observation(agent_id=None), "identity"), (observation(timestamp="soon"), "timestamp"), (observation(payload=None), "payload"),
        (observation(event_id="0" * 64), "event_id"), (observation(unknown=1), None), (observation(schema_version=1.0), None),
    ]
    got = codec.decode(frame(spark, [c for c, _ in cases]), "RequestObservation", OBSERVATION_PAYLOAD).orderBy("offset").collect()
    assert [r["problem"] for r in got] == [p for _, p in cases]
    good = codec.decode(frame(spark, [observation()]), "RequestObservation", OBSERVATION_PAYLOAD)
    assert good.select(codec.observation_problem().alias("p")).first()["p"] is None
    other = codec.decode(frame(spark, [observation()], "9.9.9.9"), "RequestObservation", OBSERVATION_PAYLOAD)
    assert other.select(codec.observation_problem().alias("p")).first()["p"] == "key"


def test_encode_round_trip(spark):
    rows = spark.createDataFrame([("trie", 7, 1, "2027-01-15T08:00:00Z", "10.0.0.0/8", 3, "16777216", None)], "agent_id string, sequence long, config_version int, timestamp string, prefix string, hot_count long, capacity string, hot_ratio double")
    out = codec.encode(rows, "PrefixStatsChanged", ["prefix", "hot_count", "capacity", "hot_ratio", "sequence", "timestamp"], F.col("prefix"))
    body = json.loads(out.first()["value"])
    assert body["event_id"] == rightful("trie", 7, "PrefixStatsChanged", "10.0.0.0/8") and "hot_ratio" not in body["payload"]
    back = codec.decode(out.select(F.lit("prefix-stats").alias("topic"), F.lit(0).alias("partition"), F.lit(0).cast("long").alias("offset"), F.col("prefix").alias("key"), F.col("event_id").alias("message_id"), "value"), "PrefixStatsChanged", PREFIX_STATS_PAYLOAD).first()
    assert back["problem"] is None and (back["payload"]["prefix"], back["payload"]["hot_count"]) == ("10.0.0.0/8", 3)
    plain = codec.encode(rows.drop("prefix").withColumn("prefix", F.lit("x")), "PrefixStatsChanged", ["prefix"])
    assert json.loads(plain.first()["value"])["event_id"] == rightful("trie", 7, "PrefixStatsChanged")


def test_integers(spark):
    cases = [('{"n": 5}', 5), ('{"n": 5.0}', 5), ('{"n": "5"}', None), ('{"n": true}', None), ('{"n": 5.5}', None), ('{"n": -3}', -3), ("{}", None), ('{"n": null}', None), ('{"n": 99999999999999999999}', None)]
    got = spark.createDataFrame([(c,) for c, _ in cases], "raw string").select(codec.json_integer(F.col("raw"), "$.n").alias("n")).collect()
    assert [r["n"] for r in got] == [n for _, n in cases]
    text = spark.createDataFrame([("0",), ("01",), ("340282366920938463463374607431768211456",), ("-1",), (None,)], "t string").select(codec.decimal_text(F.col("t")).alias("v")).collect()
    assert [r["v"] for r in text] == [True, False, True, False, False]


def test_log(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = lambda ids, at=0: spark.createDataFrame([(f"10.0.0.{i % 5}", f"m{i}", f"v{i}", at + k) for k, i in enumerate(ids)], "key string, message_id string, value string, position long")
    assert logs.provision(spark, path).count() == 0
    logs.publish(spark, path, "hot-ip", rows([0, 1, 2, 3, 4, 5, 5, 6]))
    logs.publish(spark, path, "hot-ip", rows([5, 6, 7, 8, 9], 100))
    log = logs.provision(spark, path)
    got = log.collect()
    assert sorted(r["message_id"] for r in got) == sorted(f"m{i}" for i in range(10))
    for r in logs.bounds(log).collect():
        mine = sorted((x["offset"], x["value"]) for x in got if x["partition"] == r["partition"])
        assert [o for o, _ in mine] == list(range(len(mine))) and (r["first_offset"], r["end_offset"], r["last_value"]) == (0, len(mine), mine[-1][1])
    assert logs.misrouted(log, "hot-ip").count() == 0 and logs.misrouted(log.withColumn("key", F.lit("zz")), "hot-ip").count() > 0
    assert logs.replay(log, 1).count() == sum(r["offset"] >= 1 for r in got)
    done = logs.bounds(log).select("partition", (F.col("end_offset") - 1).alias("position"))
    assert logs.unhandled(log.union(log), done).count() == done.count()
    spark.createDataFrame([(1,)], "x int").write.parquet(str(tmp_path / "other"))
    with pytest.raises(ValueError, match="schema"):
        logs.provision(spark, str(tmp_path / "other"))


def test_subjects(spark):
    texts = ["hot-ip.0", "hot-ip.31", "hot-ip.32", "hot-ip.01", "hot-ip.", "hot-ip.-1", "other.1", "hot-ip.9999999999", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(logs.partition_of("hot-ip", F.col("t")).alias("p")).collect()
    assert [r["p"] for r in got] == [0, 31, None, None, None, None, None, None, None]
    df = spark.range(5).withColumnRenamed("id", "sequence")
    assert df.select(logs.subject_of("hot-ip", F.col("sequence")).alias("s")).first()["s"] == "hot-ip.0"
    assert logs.republished(df, 3).count() == 2 and logs.republished(df, None).count() == 5


def test_read_observations(spark, tmp_path):
    (tmp_path / "o.json").write_text(json.dumps(json.loads(observation())["payload"]) + "\n{broken\n")
    rows = logs.read_observations(spark, str(tmp_path)).cache().collect()
    assert rows[0]["observations"][0]["ip"] == "1.2.3.4" and rows[1]["corrupt"] == "{broken"
    assert logs.read_observations(spark, str(tmp_path), streaming=True).isStreaming


def test_agents(spark, tmp_path):
    key, p = b"k", tmp_path / "agents.json"
    one = lambda c: c * 64
    doc = lambda agents, **change: json.dumps({"registry_version": 2, "hash_algorithm": "hmac-sha256", "key_id": logs.key_id(key), "agents": agents} | change)
    p.write_text(doc({"a": {"token_hash": one("a"), "rate_limit_rps": 5}, "b": {"token_hash": one("B"), "enabled": False, "previous_token_hash": one("c"), "previous_token_expires_at": "2027-01-15T09:00:00+01:00"}}))
    assert sorted(map(tuple, logs.load_agents(spark, str(p), key).collect())) == [("a", one("a"), None, None, True, 5), ("b", one("b"), one("c"), 1800000000, False, None)]
    good = {"token_hash": one("a")}
    for bad in (
        doc({"a": good}).replace('"a": {', '"a": {"enabled": true}, "a": {'), doc({"a": good}, registry_version=1), doc({"a": good}, key_id="0" * 16), doc({"a": good}, more=1), doc([]), doc({"a": {}}), doc({"a": good | {"token": "x"}}), doc({"a": good, "b": good}),
        doc({"a": {"token_hash": "xyz"}}), doc({"a": good | {"previous_token_hash": one("b")}}), doc({"a": good | {"previous_token_hash": one("b"), "previous_token_expires_at": "2027-01-15T09:00:00"}}),
        doc({"a": good | {"previous_token_hash": one("a"), "previous_token_expires_at": "2027-01-15T09:00:00Z"}}), doc({"a": good | {"rate_limit_rps": 0}}), doc({"a": good | {"enabled": 1}}),
    ):
        p.write_text(bad)
        with pytest.raises(ValueError):
            logs.load_agents(spark, str(p), key)


def test_attributes(spark):
    good = {'{"attributes_version": 1}': '{"attributes_version":1}', '{ "attributes_version":1.0,"weight": 5.0, "x_a":"é" }': '{"attributes_version":1,"weight":5,"x_a":"\\u00e9"}', '{"attributes_version":2,"anything":[1]}': '{"attributes_version":2,"anything":[1]}'}
    bad = ["", "[]", "{}", '{"attributes_version":0}', '{"attributes_version":true}', '{"attributes_version":1,"weight":-1}', '{"attributes_version":1,"weight":1000001}', '{"attributes_version":1,"weight":"5"}', '{"attributes_version":1,"other":1}',
           '{"attributes_version":1,"x_":1}', '{"attributes_version":1,"x_a":NaN}', '{"attributes_version":1,"x_a":1,"x_a":2}', '{"attributes_version":1,"x_a":' + "9" * 700 + "}", '{"attributes_version":1,"x_a":"' + "y" * 1100 + '"}',
           json.dumps({"attributes_version": 1} | {f"x_{k}": 1 for k in range(16)}), '{"attributes_version":1,"x_a":' + "[" * 3000]
    texts = [*good, *bad, None]
    got = [r["c"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(canonicalize(F.col("t")).alias("c")).collect()]
    assert got == [*good.values(), *[None] * (len(bad) + 1)]
    assert canonical(canonical(next(iter(good)))) == '{"attributes_version":1}'
    assert spark.range(1).select(simple_weight(F.lit('{"attributes_version":1,"weight":7}')).alias("w")).first()["w"] == 7


@pytest.mark.parametrize("hot", [1, 3, 200, 1000])
def test_weight(spark, hot):
    counts = [0, 1, 2, 5, 99, 100, 101, 299, 1200, 999_999, 10**9, 10**12]
    got = spark.createDataFrame([(c,) for c in counts], "c long").select(threshold_ratio(F.col("c"), hot).alias("w")).collect()
    assert [r["w"] for r in got] == [min(max((1000 * c + hot // 2) // hot, 0), 1_000_000) for c in counts]


def test_hashes(spark):
    texts = ["", "a", "foobar", "10.20.30.1", "é😀"]

    def fnv(t):
        h = 2166136261
        for b in t.encode():
            h = ((h ^ b) * 16777619) % 2**32
        return h

    key = b"salt"
    mac = lambda t: hmac.new(key, t.encode(), hashlib.sha256)
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(H.fnv1a(F.col("t")).alias("f"), H.partition_for(F.col("t"), 128).alias("p"), H.keyed_hash(key)(F.col("t")).alias("k"), H.agent_slot(key)(F.col("t")).alias("s")).collect()
    assert fnv("a") == 0xE40C292C
    assert [tuple(r) for r in got] == [(fnv(t), fnv(t) % 128, mac(t).hexdigest(), int.from_bytes(mac(t).digest(), "big") % 4096) for t in texts]


def test_time(spark):
    df = spark.createDataFrame([(-7,), (0,), (59,), (60,)], "s long").select(B.bucket_start(F.col("s"), 10).alias("b"), B.bucket_index(F.col("s"), 10, 6).alias("i"))
    assert [tuple(r) for r in df.collect()] == [(-10, 5), (0, 0), (50, 5), (60, 0)]
    texts = ["2027-01-15T08:00:00Z", "2027-01-15T10:00:00+02:00", "2027-01-15T08:00:00", "2027-01-15T08:00:00.250Z", "later", None]
    got = [r["f"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(B.format_rfc3339(B.parse_rfc3339(F.col("t"))).alias("f")).collect()]
    assert got == ["2027-01-15T08:00:00Z", "2027-01-15T08:00:00Z", "2027-01-15T08:00:00Z", "2027-01-15T08:00:00.250000Z", None, None]
    seconds = spark.sql("SELECT TIMESTAMP_NTZ'2024-03-31 02:30:15.9' AS a, TIMESTAMP_NTZ'1969-12-31 23:59:59' AS b").select(B.epoch_seconds(F.col("a")).alias("a"), B.epoch_seconds(F.col("b")).alias("b")).first()
    assert tuple(seconds) == (1711852215, -1)
    assert spark.range(1).select(B.is_aligned(F.lit(20_000_000), 10).alias("y"), B.is_aligned(F.lit(20_000_001), 10).alias("n")).first()[:] == (True, False)
