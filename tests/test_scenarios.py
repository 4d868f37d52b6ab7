"""Worked scenarios with known numbers: hysteresis, expiry, prefixes, recovery, changes of parameters."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from emberlake import api
from emberlake.config import DetectionConfig, accepted_versions, parse_shards
from emberlake.functions import addressing as A
from emberlake.operators import activity, audit, classify, folds, ingest, metadata, ordering, prefixes
from emberlake.sources import log as logs

T0 = 1_800_000_000
CFG = DetectionConfig()


def ip(text):
    a, b, c, d = map(int, text.split("."))
    return (a << 24) + (b << 16) + (c << 8) + d


def hosts(base, n, count, bucket=T0, first=1):
    return [(ip(base) + i, bucket, count) for i in range(first, first + n)]


def buckets(spark, rows):
    return spark.createDataFrame(rows, "ip long, bucket long, requests long")


def events(spark, rows, cfg=CFG, until=None):
    out = activity.hot_ip_events(activity.edges(activity.timeline(buckets(spark, rows), cfg)), cfg, 1)
    return out.where(F.col("t") <= until) if until else out


def test_decision_table(spark):
    cases = [(0, 799, 0), (0, 800, 0), (0, 999, 0), (0, 1000, 1), (1, 1000, 1), (1, 900, 1), (1, 800, 1), (1, 799, 0)]
    rows = [(k, 0, 1, 1000 if s else 0) for k, (s, _, _) in enumerate(cases)] + [(k, 1, 1, c) for k, (_, c, _) in enumerate(cases)]
    df = activity.hysteresis(spark.createDataFrame(rows, "ip long, t long, phase int, total long"), F.lit(1000), F.lit(800))
    assert [r["state"] for r in df.where("t = 1").orderBy("ip").collect()] == [w for _, _, w in cases]


def test_hysteresis_random(spark):
    rng = random.Random(3)
    rows = [(k, t, 1, rng.randrange(600, 1200)) for k in range(20) for t in range(60)]
    got = {(r["ip"], r["t"]): r["state"] for r in activity.hysteresis(spark.createDataFrame(rows, "ip long, t long, phase int, total long"), F.lit(1000), F.lit(800)).collect()}
    for k, group in itertools.groupby(rows, key=lambda r: r[0]):
        state = 0
        for _, t, _, c in group:
            state = 1 if c >= 1000 else 0 if c < 800 else state
            assert got[k, t] == state


def test_single_hot_and_expiry(spark):
    got = events(spark, [(ip("10.20.30.1"), T0, 1200)]).orderBy("t").collect()
    assert [(r["type"], r["t"], r["window_count"], r["weight"], r["attributes"]) for r in got] == [("HotIpAdded", T0, 1200, 1200, '{"attributes_version":1,"weight":1200}'), ("HotIpRemoved", T0 + 300, 0, None, None)]
    changed = prefixes.stats_changelog(prefixes.effective_changes(events(spark, [(ip("10.20.30.1"), T0, 1200)]), ("t", "phase")))
    rows = changed.collect()
    assert len(rows) == 50 and {r["hot_count"] for r in rows if r["delta"] == 1} == {1} and {r["hot_count"] for r in rows if r["delta"] == -1} == {0}


def test_sliding_window_against_plain_python(spark):
    rng = random.Random(9)
    rows = [(k, T0 + 10 * b, rng.randrange(1, 90)) for k in range(5) for b in sorted(rng.sample(range(120), 40))]
    by = {(r[0], r[1]): r[2] for r in rows}
    for r in activity.sliding_totals(buckets(spark, rows), CFG).collect():
        assert r["total"] == sum(by.get((r["ip"], r["bucket"] - 10 * k), 0) for k in range(30))
    for r in activity.window_ticks(buckets(spark, rows), CFG).collect():
        live = sum(n for (k, b), n in by.items() if k == r["ip"] and (b <= r["t"] - (r["phase"] == 0) and b + 300 > r["t"]))
        assert r["total"] == live


@pytest.mark.parametrize(("age", "want"), [(-1, "future"), (0, "applied"), (290, "applied"), (291, "expired_bucket"), (330, "expired_bucket"), (331, "late")])
def test_lateness_edges(spark, age, want):
    df = spark.createDataFrame([(T0, T0 - age, 10)], "now long, start long, w int")
    assert df.select(activity.lateness_outcome(F.col("now"), F.col("start"), F.col("w"), CFG).alias("o")).first()["o"] == want


def test_too_long(spark):
    df = spark.createDataFrame([(T0, T0, 301)], "now long, start long, w int")
    assert df.select(activity.lateness_outcome(F.col("now"), F.col("start"), F.col("w"), CFG).alias("o")).first()["o"] == "window_too_long"


def listing(spark, rows, minimal=False):
    hot = prefixes.hot_set(events(spark, rows, until=T0))
    return [(r["prefix"], r["hot_ips"], r["hot_ratio"]) for r in api.hot_prefixes(hot, CFG, only_minimal=minimal).orderBy("position").collect()]


def test_bot_network(spark):
    rows = hosts("10.20.30.0", 156, 1200) + [(ip("198.51.100.7"), T0, 500000)]
    got = listing(spark, rows)
    assert ("10.20.30.0/24", 156, 0.609375) in got and not any(p.endswith("/16") for p, _, _ in got)
    assert [p for p, _, _ in got if int(p.split("/")[1]) <= 24] == ["10.20.30.0/24", "10.20.30.0/23", "10.20.28.0/22", "10.20.24.0/21"][: len([p for p, _, _ in got if int(p.split("/")[1]) <= 24])]
    hot = prefixes.hot_set(events(spark, rows, until=T0))
    assert {r["ip"]: r["attributes"] for r in hot.collect()}[ip("198.51.100.7")] == '{"attributes_version":1,"weight":500000}'
    view = api.ip_view(spark.createDataFrame([(ip("10.20.30.1"),), (ip("9.9.9.9"),)], "ip long"), hot, prefixes.prefix_counts(hot), CFG)
    one, other = view.orderBy(F.desc("ip")).collect()
    assert [(m["prefix"], m["hot_ips"], m["state"]) for m in one["matched_prefixes"]] == [("10.0.0.0/8", 156, "NORMAL"), ("10.20.0.0/16", 156, "NORMAL"), ("10.20.30.0/24", 156, "HOT_PREFIX")]
    assert (one["state"], one["request_count"], other["state"], other["request_count"], other["attributes"]) == ("HOT", 1200, "COLD", 0, None)


def test_two_networks(spark):
    rows = hosts("10.20.30.0", 156, 1200) + hosts("10.20.31.0", 156, 1200)
    got = listing(spark, rows)
    short = [p for p, _, _ in got if int(p.split("/")[1]) <= 24]
    assert short == ["10.20.30.0/24", "10.20.31.0/24", "10.20.30.0/23", "10.20.28.0/22", "10.20.24.0/21"]


def test_minimal_is_the_long_definition(spark):
    rng = random.Random(11)
    for _ in range(4):
        rows = [(ip("10.0.0.0") + a, T0, 1200) for a in {rng.randrange(2048) for _ in range(rng.randrange(20, 500))}]
        every, least = listing(spark, rows), {p for p, _, _ in listing(spark, rows, True)}
        span = lambda p: (ip(p.split("/")[0]), 2 ** (32 - int(p.split("/")[1])))
        for p, _, _ in every:
            a, n = span(p)
            inner = any(q != p and a <= span(q)[0] and span(q)[0] + span(q)[1] <= a + n for q, _, _ in every)
            assert (p in least) == (not inner)


def test_change_of_parameters(spark):
    rows = hosts("10.20.30.0", 32, 600)
    low = DetectionConfig(config_version=2, hot_threshold=500, cold_threshold=400)
    edges = activity.edges(activity.reevaluated(buckets(spark, rows), CFG, low, T0 + 60)).where(F.col("t") <= T0 + 60)
    assert edges.where("state = 1 and config_version = 2 and total = 600").count() == 32
    got = activity.hot_ip_events(edges, low, 1)
    assert {r["weight"] for r in got.collect()} == {1200}
    hot = prefixes.hot_set(got)
    assert ("10.20.30.0/24", 32, 0.125) in [(r["prefix"], r["hot_ips"], r["hot_ratio"]) for r in api.hot_prefixes(hot, low).collect()]
    back = activity.edges(activity.reevaluated(buckets(spark, rows), low, DetectionConfig(config_version=3), T0 + 60)).where(F.col("t") <= T0 + 60)
    assert back.where("state = 0 and total = 600 and config_version = 3").count() == 32


def test_recovery(spark, tmp_path):
    def event(k, seq, kind):
        return (ip("10.20.30.0") + k, T0 + seq, 1, 0, kind, 1200 if kind == "HotIpAdded" else 0, seq, '{"attributes_version":1}' if kind == "HotIpAdded" else None)

    rows = [event(k, k - 1, "HotIpAdded") for k in range(1, 101)] + [event(k, 99 + k, "HotIpRemoved") for k in range(1, 101)] + [event(k, 99 + k, "HotIpAdded") for k in range(101, 157)]
    df = spark.createDataFrame(rows, "ip long, t long, phase int, shard int, type string, window_count long, sequence long, attributes string")
    full = prefixes.hot_set(df)
    assert full.count() == 56 and prefixes.log_position(df).first()["event_sequence"] == 256
    early = df.where("sequence < 120")
    logs.snapshot(prefixes.hot_set(early), prefixes.log_position(early), T0, 1, str(tmp_path / "s"))
    hot, tail = logs.restore(spark, str(tmp_path / "s"), df)
    assert tail.count() == 136
    assert sorted(map(tuple, logs.resume(hot, tail).collect())) == sorted(map(tuple, full.collect()))
    for broken in (df.where("sequence >= 130"), df.where("sequence < 50")):
        with pytest.raises(ValueError, match="gap"):
            logs.restore(spark, str(tmp_path / "s"), broken)


def test_redundant_events(spark):
    rows = [(1, T0 + k, 1, kind, n, f"a{n}") for k, (kind, n) in enumerate([("HotIpRemoved", 0), ("HotIpAdded", 5), ("HotIpAdded", 7), ("HotIpRemoved", 0), ("HotIpRemoved", 0), ("HotIpAdded", 9)])]
    log = spark.createDataFrame(rows, "ip long, t long, phase int, type string, window_count long, attributes string")
    assert [r["window_count"] for r in prefixes.effective_changes(log, ("t", "phase")).orderBy("t").collect()] == [5, 0, 9]
    assert prefixes.hot_set(log.where(F.col("t") <= T0 + 2)).first()["request_count"] == 7


def test_prefix_counts_and_walk(spark):
    rng = random.Random(2)
    pool = {0, 1, 2**31, 2**32 - 2, 2**32 - 1} | {ip("10.1.2.3") ^ (1 << rng.randrange(12)) for _ in range(20)}
    hot = spark.createDataFrame([(x,) for x in pool], "ip long")
    for low in (0, 8, 17, 32):
        got = {(r["length"], r["network"]): r["hot_count"] for r in prefixes.prefix_counts(hot, low).collect()}
        want = {}
        for x in pool:
            for n in range(low, 33):
                key = (n, x >> (32 - n) << (32 - n))
                want[key] = want.get(key, 0) + 1
        assert got == want
    counts = prefixes.prefix_counts(hot, 0)
    assert audit.count_mismatches(counts, hot, 0).count() == 0
    assert audit.count_mismatches(counts.withColumn("hot_count", F.col("hot_count") + (F.col("length") == 9).cast("long")), hot, 0).count() > 0
    best = prefixes.longest_match(spark.createDataFrame([(0,), (3,), (2**32 - 3,)], "ip long"), counts)
    assert {r["ip"]: r["length"] for r in best.collect()} == {0: 32, 3: 31 if 2 in pool else 30, 2**32 - 3: 30}


def test_decay(spark):
    rows = hosts("10.20.30.0", 156, 1200) + [(ip("198.51.100.7"), T0, 500000)] + hosts("10.20.30.0", 15, 1200, T0 + 200) + [(ip("198.51.100.7"), T0 + 200, 900)]
    log = events(spark, rows, until=T0 + 310)
    hot = prefixes.hot_set(log)
    view = api.prefix_view(spark.createDataFrame([(24, ip("10.20.30.0"))], "length int, network long"), prefixes.prefix_counts(hot), CFG).first()
    assert (view["hot_ips"], view["hot_ratio"], view["state"]) == (15, 0.05859375, "NORMAL")
    assert hot.where(F.col("ip") == ip("198.51.100.7")).count() == 1
    found = classify.detections(prefixes.stats_changelog(log), CFG)
    assert found.where("length <= 24").count() == 0


def test_ingest(spark):
    batch = spark.createDataFrame([("a", 1, 7, 5), ("a", 1, 7, 6), ("a", 1, 8, 0), ("b", 1, 7, 900_000_000), ("b", 1, 7, 200_000_000), ("b", 1, 9, 1)], "agent_id string, batch long, ip long, request_count long")
    assert [tuple(r) for r in ingest.coalesced(batch).collect()] == [("a", 1, 7, 11)]
    assert {r["agent_id"]: r["cost"] for r in ingest.batch_cost(batch).collect()} == {"a": 2, "b": 2}
    seen = spark.createDataFrame([("a", s) for s in (0, 1, 2, 4, 5, 5)] + [("b", 9)], "agent_id string, sequence long")
    assert {r["agent_id"]: (r["mark"], r["ahead"]) for r in ingest.high_water_marks(seen).collect()} == {"a": (2, 2), "b": (-1, 1)}
    rng = random.Random(3)
    many = {f"g{k}": {s for s in range(rng.randrange(1, 40)) if rng.random() < 0.97 or s < 20} | {50, 63, 64} for k in range(12)} | {"late": {3, 4}, "all": set(range(64))}
    frame = spark.createDataFrame([(a, s) for a, x in many.items() for s in x], "agent_id string, sequence long")
    for span in (1, 7, 16, 1 << 16):
        for r in ingest.high_water_marks(frame, span).collect():
            mark = next(s for s in range(100) if s not in many[r["agent_id"]]) - 1
            assert (r["mark"], r["ahead"]) == (mark, len([s for s in many[r["agent_id"]] if s > mark])), (r, span)
    body = spark.createDataFrame([('{"agent_id":"a","extra":1}',)], "raw string")
    row = body.select(ingest.unknown_keys(F.col("raw")).alias("k"), ingest.body_too_large(F.col("raw"), 10).alias("b"), ingest.retry_after(F.lit(7), F.lit(1.0), 2.0).alias("r")).first()
    assert (row["k"], row["b"], row["r"]) == (["extra"], True, 3)


def test_token_bucket(spark):
    rng = random.Random(4)
    calls = [("x", T0 + t, k, rng.randrange(1, 6)) for k, t in enumerate(sorted(rng.choices(range(60), k=80)))]
    got = {r["id"]: (r["allowed"], r["tokens"]) for r in folds.token_bucket(spark.createDataFrame(calls, "agent_id string, t long, id long, cost long"), 1.5, 10).collect()}
    tokens, last = 10.0, calls[0][1]
    for _, t, k, cost in calls:
        tokens, last = min(10.0, tokens + (t - last) * 1.5), t
        ok = tokens >= cost
        tokens -= cost if ok else 0
        assert got[k] == (ok, pytest.approx(tokens))


def test_token_bucket_refuses_wrong_arguments(spark):
    calls = spark.createDataFrame([("x", 0, 1, 0), ("x", 0, 2, 11), ("x", 0, 3, 10), ("x", 0, 4, None), ("x", 0, 5, 1), ("y", 0, 6, -1)], "agent_id string, t long, id long, cost long")
    got = {r["id"]: (r["allowed"], r["problem"], r["tokens"]) for r in folds.token_bucket(calls, 1.0, 10.0).collect()}
    assert got == {1: (None, "cost", 10.0), 2: (None, "cost", 10.0), 3: (True, None, 0.0), 4: (None, "cost", 0.0), 5: (False, None, 0.0), 6: (None, "cost", 10.0)}
    for rate, burst in ((0, 1), (1, 0), (float("inf"), 1), (1, float("nan"))):
        with pytest.raises(ValueError):
            folds.token_bucket(calls, rate, burst)


def test_two_level_order(spark):
    rng = random.Random(11)
    data = [(rng.choice("ab"), rng.randrange(300), k, rng.randrange(50)) for k in range(400)]
    frame = spark.createDataFrame(data, "key string, t long, id long, value long")
    order = sorted(data, key=lambda x: (x[0], x[1], x[2]))
    want, seen = {}, {}
    for key, _, k, value in order:
        last = seen.setdefault(key, [])
        want[k] = (len(last), last[-1] if last else -1, max(last) if last else None, sum(last) + value)
        last.append(value)
    for span in (1, 30, 10_000):
        got = ordering.numbered(frame, ["key"], "t", ["t", "id"], "n", span)
        got = ordering.previous(got, ["key"], "value", "t", ["t", "id"], F.lit(-1), "p", span)
        got = ordering.greatest_before(got, ["key"], "value", "t", ["t", "id"], "g", span)
        got = ordering.running_sum(got, ["key"], "value", "t", ["t", "id"], span)
        assert {r["id"]: (r["n"], r["p"], r["g"], r["running"]) for r in got.collect()} == want


def test_lease(spark):
    steps = [(0, "a", "acquire", True), (5, "b", "acquire", False), (9, "a", "acquire", True), (12, "b", "release", False), (13, "a", "release", True), (14, "b", "acquire", True), (24, "a", "acquire", True), (25, "b", "release", False)]
    df = spark.createDataFrame([(0, t, k, o, a) for k, (t, o, a, _) in enumerate(steps)], "shard int, t long, id long, owner string, action string")
    assert [r["granted"] for r in folds.lease_history(df, 10).orderBy("id").collect()] == [g for *_, g in steps]


def test_metadata(spark):
    declared = spark.createDataFrame([(8, ip("10.0.0.0"), "z", "tags", "internal", None, None), (24, ip("10.20.30.0"), "z", "tags", "edge", None, None), (8, ip("10.0.0.0"), "o", "override", None, None, "low"), (32, ip("10.20.30.1"), "o", "override", None, None, "high"), (0, 0, "m", "bitmask", None, 1, None), (16, ip("10.20.0.0"), "m", "bitmask", None, 6, None), (24, ip("10.20.30.0"), "m", "tags", "odd", None, None)], "length int, network long, key string, kind string, tag string, bits long, override string")
    got = {(r["key"], r["kind"]): (r["tags"], r["bits"], r["override"]) for r in metadata.effective(spark.createDataFrame([(ip("10.20.30.1"),)], "ip long"), declared).collect()}
    assert got == {("z", "tags"): (["edge", "internal"], None, None), ("o", "override"): ([], None, "high"), ("m", "bitmask"): ([], 7, None), ("m", "tags"): (["odd"], None, None)}
    assert {(r["length"], r["other_length"]) for r in metadata.conflicts(declared).collect()} == {(24, 0), (24, 16)}
    log = spark.createDataFrame([(1, 8, 0, "a"), (2, 8, 0, "b"), (1, 9, 0, "c"), (2, 9, 0, None)], "version int, length int, network long, document string")
    assert [r["document"] for r in metadata.declared_now(log).collect()] == ["b"]


def test_config(tmp_path, spark):
    assert DetectionConfig.from_json(CFG.to_json()) == CFG
    for bad in ('{"hot_threshold": 5}', '{"nope": 1}', '{"window_seconds": 305}', '{"config_version": "1"}', '{"config_version": true}', '{"config_version":1,"config_version":1}', "[]", '{"minimum_hot_ratio": 1.5}', '{"weight_max": 1000001}', '{"weight_max": 999}'):
        with pytest.raises(ValueError):
            DetectionConfig.from_json(bad)
    (tmp_path / "c.json").write_text('{"config_version": 2.0, "minimum_hot_ratio": 0}')
    assert DetectionConfig.load(str(tmp_path / "c.json")).config_version == 2
    seen = spark.createDataFrame([(1, 3), (2, 3), (3, 2), (4, 5)], "seen_at long, config_version int")
    assert [r["config_version"] for r in accepted_versions(seen).orderBy("seen_at").collect()] == [3, 5]


def test_shard_lists():
    assert parse_shards("all", 3) == (0, 1, 2) and parse_shards("7, 0-2", 8) == (0, 1, 2, 7)
    for bad in ("", "a", "3-1", "0-128", "1,1", "0-2,2", "-1"):
        with pytest.raises(ValueError):
            parse_shards(bad)


def test_ipv6_prefixes(spark):
    text = ["::1", "2001:db8::ff", "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff", "::ffff:10.0.0.1", "1.2.3.4", "x", None, "fe80::1%eth0"]
    df = spark.createDataFrame([(t,) for t in text], "t string").withColumn("v", A.parse_ipv6(F.col("t"))).withColumn("back", A.format_ipv6(F.col("v.hi"), F.col("v.lo")))
    assert [r["back"] for r in df.collect()] == ["::1", "2001:db8::ff", "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff", "::ffff:10.0.0.1", None, None, None, None]
    wide = df.where("v.hi is not null").withColumn("length", F.explode(F.sequence(F.lit(0), F.lit(128))))
    hi, lo = A.mask_ipv6(F.col("v.hi"), F.col("v.lo"), F.col("length"))
    import ipaddress

    for r in wide.select("t", "length", A.format_ipv6(hi, lo).alias("n"), A.capacity_text(F.col("length"), 128).alias("c"), A.hot_ratio(F.lit(1), F.col("length"), 128).alias("q")).collect():
        net = ipaddress.ip_network(f"{r['t']}/{r['length']}", strict=False)
        assert r["n"] == str(net.network_address) and r["c"] == str(net.num_addresses) and r["q"] == 1 / net.num_addresses
    keys = spark.createDataFrame([("1.2.3.4",), ("::ffff:1.2.3.4",), ("2001:db8:1:2:3::4",), ("no",)], "t string").select(A.source_key(F.col("t")).alias("k")).collect()
    assert [k["k"] for k in keys] == ["1.2.3.4/32", "1.2.3.4/32", "2001:db8:1:2::/64", None]


def test_ipv6_counts(spark):
    import ipaddress

    texts = ["2001:db8::1", "2001:db8::2", "2001:db8::ffff:1", "::1", "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff"]
    hot = spark.createDataFrame([(t,) for t in texts], "t string").select(A.parse_ipv6(F.col("t")).alias("v")).select("v.*")
    for low in (104, 60):
        want = {}
        for t in texts:
            for n in range(low, 129):
                net = ipaddress.ip_network(f"{t}/{n}", strict=False)
                want[str(net)] = want.get(str(net), 0) + 1
        rows = prefixes.with_stats_ipv6(prefixes.prefix_counts_ipv6(hot, low)).orderBy("order").collect()
        assert {r["prefix"]: r["hot_count"] for r in rows} == want
        nets = [ipaddress.ip_network(r["prefix"]) for r in rows]
        assert nets == sorted(nets, key=lambda x: (-x.prefixlen, int(x.network_address)))
        assert all(r["hot_ratio"] == r["hot_count"] / int(r["capacity"]) for r in rows)


def test_ipv4_text(spark):
    text = ["0.0.0.0", "255.255.255.255", "01.2.3.4", "1.2.3", "256.1.1.1", "1.2.3.4 ", None]
    got = [r["v"] for r in spark.createDataFrame([(t,) for t in text], "t string").select(A.parse_ipv4(F.col("t")).alias("v")).collect()]
    assert got == [0, 2**32 - 1, None, None, None, None, None]
    prefix = ["10.0.0.0/8", "10.0.0.1/8", "10.0.0.1", "10.0.0.0/33", "0.0.0.0/0", "1.1.1.1/32/1", "a/8"]
    got = [r["v"] and tuple(r["v"]) for r in spark.createDataFrame([(t,) for t in prefix], "t string").select(A.parse_prefix(F.col("t")).alias("v")).collect()]
    assert got == [(8, ip("10.0.0.0")), None, (32, ip("10.0.0.1")), None, (0, 0), None, None]
    xff = spark.createDataFrame([("9.9.9.9, 1.2.3.4, 5.6.7.8",), ("1.2.3.4",), ("x, 1.1.1.1",)], "h string").select(A.forwarded_client(F.col("h"), 2).alias("c")).collect()
    assert [r["c"] for r in xff] == ["1.2.3.4", None, None]
