"""SQL of the registered queries, on the supplied tables, as common table expressions."""

from __future__ import annotations

#: Moment of the change of parameters in the re-evaluation queries: the middle of the events.
CHANGE_AT = 1705363200

_OBS = """obs AS (SELECT event_type AS agent_id, event_id AS sequence, 169090560 + user_id AS ip, CAST(floor(value) AS BIGINT) AS request_count,
  CAST(floor(epoch(ts)) AS BIGINT) AS t, CAST(floor(epoch(ts)) AS BIGINT) - CAST(floor(epoch(ts)) AS BIGINT) % 3600 AS bucket FROM events)"""
_LATE = """late AS (SELECT *, t + (sequence * 7919) % 120000 - 10000 AS now, CASE WHEN sequence % 50 = 0 THEN 90000 ELSE 3600 END AS window_seconds FROM obs),
classified AS (SELECT *, CASE WHEN window_seconds > 86400 THEN 'window_too_long' WHEN t > now THEN 'future' WHEN now - t > 88200 THEN 'late'
  WHEN (now - now % 3600) - (t - t % 3600) >= 86400 THEN 'expired_bucket' ELSE 'applied' END AS outcome FROM late)"""
_BUCKETS = "buckets AS (SELECT ip, bucket, CAST(sum(request_count) AS BIGINT) AS requests FROM obs WHERE request_count > 0 GROUP BY ip, bucket)"
_TICKS = """raw_ticks AS (SELECT ip, bucket AS t, 1 AS phase, requests AS delta FROM buckets UNION ALL SELECT ip, bucket + 172800, 0, -requests FROM buckets),
ticks AS (SELECT *, CAST(sum(delta) OVER (PARTITION BY ip ORDER BY t, phase ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM raw_ticks)"""
_STATES = """states AS (SELECT *, CAST(coalesce(last_value(CASE WHEN total >= 200 THEN 1 WHEN total < 120 THEN 0 END IGNORE NULLS)
  OVER (PARTITION BY ip ORDER BY t, phase ROWS UNBOUNDED PRECEDING), 0) AS INTEGER) AS state FROM ticks)"""
_EDGES = """flagged AS (SELECT *, coalesce(lag(state) OVER (PARTITION BY ip ORDER BY t, phase), 0) AS before FROM states),
edges AS (SELECT ip, t, phase, delta, total, state FROM flagged WHERE state <> before)"""
_EVENTS = """numbered AS (SELECT ip, t, phase, CAST(ip % 8 AS INTEGER) AS shard, CASE WHEN state = 1 THEN 'HotIpAdded' ELSE 'HotIpRemoved' END AS type, total AS window_count FROM edges),
sequenced AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY t, phase, ip) - 1 AS sequence,
  CASE WHEN type = 'HotIpAdded' THEN least(greatest((1000 * window_count + 100) // 200, 0), 1000000) END AS weight FROM numbered),
hot_events AS (SELECT *, CASE WHEN type = 'HotIpAdded' THEN '{"attributes_version":1,"weight":' || weight || '}' END AS attributes, 1 AS config_version,
  sha256('aggregator-' || shard || chr(31) || sequence || chr(31) || type || chr(31) || ip) AS event_id FROM sequenced),
moment AS (SELECT max(bucket) AS now FROM obs WHERE request_count > 0),
log AS (SELECT hot_events.* FROM hot_events, moment WHERE t <= now)"""
_HOT = """hot AS (SELECT ip, attributes, request_count, since FROM (SELECT ip, arg_max(type, t * 2 + phase) AS type, arg_max(coalesce(attributes, ''), t * 2 + phase) AS attributes,
  arg_max(window_count, t * 2 + phase) AS request_count, arg_max(t, t * 2 + phase) AS since FROM log GROUP BY ip) WHERE type = 'HotIpAdded')"""
_COUNTS = """counts AS (SELECT CAST(length AS INTEGER) AS length, (ip >> (32 - length)) << (32 - length) AS network, CAST(count(*) AS BIGINT) AS hot_count FROM hot, range(0, 33) AS r(length) GROUP BY ALL)"""
_IP = lambda c: f"(({c} >> 24) & 255) || '.' || (({c} >> 16) & 255) || '.' || (({c} >> 8) & 255) || '.' || ({c} & 255)"
_STATS = f"""stats AS (SELECT length, network, hot_count, {_IP('network')} || '/' || length AS prefix, CAST(1 AS BIGINT) << (32 - length) AS capacity,
  hot_count::DOUBLE / (CAST(1 AS BIGINT) << (32 - length))::DOUBLE AS hot_ratio FROM counts WHERE length >= 8),
rated AS (SELECT *, CASE WHEN hot_count >= 16 AND hot_ratio >= 0.1::DOUBLE THEN 'HOT_PREFIX' ELSE 'NORMAL' END AS state FROM stats)"""
_LISTED = """qualifying AS (SELECT * FROM rated WHERE state = 'HOT_PREFIX'),
least AS (SELECT * FROM qualifying q WHERE NOT EXISTS (SELECT 1 FROM qualifying x WHERE x.length > q.length AND (x.network >> (32 - q.length)) << (32 - q.length) = q.network))"""
_CHANGELOG = """changes AS (SELECT * FROM (SELECT *, coalesce(lag(type) OVER (PARTITION BY ip ORDER BY t, phase), 'HotIpRemoved') AS before FROM log) WHERE type <> before),
spread AS (SELECT ip, t, phase, CAST(length AS INTEGER) AS length, (ip >> (32 - length)) << (32 - length) AS network, CASE WHEN type = 'HotIpAdded' THEN 1 ELSE -1 END AS delta FROM changes, range(8, 33) AS r(length)),
changelog AS (SELECT *, CAST(sum(delta) OVER (PARTITION BY length, network ORDER BY t, phase, ip ROWS UNBOUNDED PRECEDING) AS BIGINT) AS hot_count FROM spread),
classified_log AS (SELECT *, hot_count::DOUBLE / (CAST(1 AS BIGINT) << (32 - length))::DOUBLE AS hot_ratio,
  CASE WHEN hot_count >= 16 AND hot_count::DOUBLE / (CAST(1 AS BIGINT) << (32 - length))::DOUBLE >= 0.1::DOUBLE THEN 'HOT_PREFIX' ELSE 'NORMAL' END AS state FROM changelog),
state_changes AS (SELECT * FROM (SELECT *, coalesce(lag(state) OVER (PARTITION BY length, network ORDER BY t, phase, ip), 'NORMAL') AS before FROM classified_log) WHERE state <> before),
last_rows AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY length, network ORDER BY t DESC, phase DESC, ip DESC) AS nth FROM classified_log) WHERE nth = 1),
last_changes AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY length, network ORDER BY t DESC, phase DESC, ip DESC) AS nth FROM state_changes) WHERE nth = 1),
found AS (SELECT l.length, l.network, l.hot_count, c.t AS since FROM last_changes c JOIN last_rows l USING (length, network) WHERE c.state = 'HOT_PREFIX')"""
_ASKED = "asked AS (SELECT DISTINCT ip FROM obs UNION ALL SELECT DISTINCT ip + 6553600 FROM obs)"
_PATHS = "paths AS (SELECT ip, CAST(length AS INTEGER) AS length, (ip >> (32 - length)) << (32 - length) AS network FROM asked, range(0, 33) AS r(length))"
_DECLARED = """declared AS (SELECT 24 AS length, CAST(169090560 + n_nationkey * 256 AS BIGINT) AS network, 'zone' AS key, 'tags' AS kind, r_name AS tag, NULL::BIGINT AS bits, NULL::VARCHAR AS override
  FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL VALUES (8, 167772160, 'zone', 'tags', 'internal', NULL, NULL), (8, 167772160, 'flags', 'bitmask', NULL, 1, NULL),
  (16, 169082880, 'flags', 'bitmask', NULL, 6, NULL), (8, 167772160, 'owner', 'override', NULL, NULL, 'core'), (24, 169090560, 'owner', 'override', NULL, NULL, 'edge'), (24, 169090816, 'flags', 'override', NULL, NULL, 'odd')),
spots AS (SELECT DISTINCT length AS own_length, network AS own_network FROM declared)"""
_FOLD = "coalesce(list_aggregate(list_sort(list_distinct(list(tag) FILTER (WHERE tag IS NOT NULL))), 'string_agg', ','), '') AS tags, bit_or(bits) AS bits, arg_max(override, length) FILTER (WHERE override IS NOT NULL) AS override"


def _q(body: str, *parts: str) -> str:
    return f"WITH {', '.join(parts)} {body}" if parts else body


_B = (_OBS, _BUCKETS)
_T = (*_B, _TICKS, _STATES)
_E = (*_T, _EDGES, _EVENTS)
_H = (*_E, _HOT)
_C = (*_H, _COUNTS)
_S = (*_C, _STATS)
_L = (*_E, _CHANGELOG)
_NOW = """current AS (SELECT ip, arg_max(total, t * 2 + phase) AS total, arg_max(state, t * 2 + phase) AS state, max(CASE WHEN phase = 1 THEN t END) AS last_seen FROM states, moment WHERE t <= now GROUP BY ip)"""
_N = (*_E, _NOW)
_CHANGED = f"""again AS (SELECT ip, t, phase, delta FROM raw_ticks UNION ALL SELECT DISTINCT ip, {CHANGE_AT}, 2, 0 FROM buckets),
summed AS (SELECT *, CAST(sum(delta) OVER (PARTITION BY ip ORDER BY t, phase ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total, t > {CHANGE_AT} OR (t = {CHANGE_AT} AND phase = 2) AS is_new FROM again),
new_states AS (SELECT *, CAST(coalesce(last_value(CASE WHEN total >= CASE WHEN is_new THEN 150 ELSE 200 END THEN 1 WHEN total < CASE WHEN is_new THEN 100 ELSE 120 END THEN 0 END IGNORE NULLS)
  OVER (PARTITION BY ip ORDER BY t, phase ROWS UNBOUNDED PRECEDING), 0) AS INTEGER) AS state FROM summed),
new_edges AS (SELECT * FROM (SELECT *, coalesce(lag(state) OVER (PARTITION BY ip ORDER BY t, phase), 0) AS before FROM new_states) WHERE state <> before)"""
_WARM = f"""warm AS (SELECT *, CAST(coalesce(last_value(CASE WHEN total >= 200 THEN 1 WHEN total < 120 AND NOT (ip % 3 = 0 AND t < {CHANGE_AT}) THEN 0 END IGNORE NULLS)
  OVER (PARTITION BY ip ORDER BY t, phase ROWS UNBOUNDED PRECEDING), CASE WHEN ip % 3 = 0 THEN 1 ELSE 0 END) AS INTEGER) AS state FROM ticks),
warm_edges AS (SELECT * FROM (SELECT *, coalesce(lag(state) OVER (PARTITION BY ip ORDER BY t, phase), CASE WHEN ip % 3 = 0 THEN 1 ELSE 0 END) AS before FROM warm) WHERE state <> before)"""
_MATCH = """matched AS (SELECT p.ip, string_agg(t.text, ',' ORDER BY t.length) AS matched FROM asked p JOIN (SELECT ip, length, """ + _IP("network") + """ || '/' || length || ':' || hot_count || ':' ||
  CASE WHEN hot_count >= 16 AND hot_count::DOUBLE / (CAST(1 AS BIGINT) << (32 - length))::DOUBLE >= 0.1::DOUBLE THEN 'HOT_PREFIX' ELSE 'NORMAL' END AS text
  FROM (SELECT paths.*, coalesce(counts.hot_count, 0) AS hot_count FROM paths LEFT JOIN counts USING (length, network) WHERE length IN (8, 16, 24))) t USING (ip) GROUP BY p.ip)"""

QUERIES: dict[str, str] = {
    "obs_projection": _q("SELECT *, t = bucket AS aligned, CAST((bucket // 3600) % 48 AS INTEGER) AS slot FROM obs", _OBS),
    "obs_rejects": _q("""SELECT sequence, CASE sequence % 10 WHEN 1 THEN 'ip' WHEN 2 THEN 'ip' WHEN 3 THEN 'request_count' WHEN 4 THEN 'request_count' WHEN 5 THEN 'agent_id'
      WHEN 6 THEN 'misaligned' WHEN 7 THEN 'window_seconds' WHEN 8 THEN 'empty' END AS reason FROM obs""", _OBS),
    "ip_text_roundtrip": _q(f"SELECT DISTINCT ip, {_IP('ip')} AS text, ip AS parsed, '00001010' AS high_bits FROM obs", _OBS),
    "prefix_text": _q(f"""SELECT *, {_IP('network')} || '/' || length AS prefix, CAST(1 AS BIGINT) << (32 - length) AS capacity, CAST(CAST(1 AS BIGINT) << (32 - length) AS VARCHAR) AS capacity_text
      FROM (SELECT DISTINCT CAST(length AS INTEGER) AS length, (ip >> (32 - length)) << (32 - length) AS network FROM obs, range(8, 33) AS r(length))""", _OBS),
    "common_prefix_length": _q("""SELECT sequence, ip, other, CAST(CASE WHEN xor(ip, other) = 0 THEN 32 ELSE 32 - length(bin(xor(ip, other))) END AS INTEGER) AS shared, CAST(ip & 1 AS INTEGER) AS last_bit
      FROM (SELECT sequence, ip, 169090560 + (sequence * 7) % 4096 AS other FROM obs)""", _OBS),
    "event_ids": _q(f"""SELECT sequence, sha256(agent_id || chr(31) || sequence || chr(31) || 'RequestObservation' || chr(31) || {_IP('ip')}) AS event_id,
      sha256(agent_id || chr(31) || sequence || chr(31) || 'RequestObservation') AS message_event_id, agent_id || chr(31) || sequence AS dedup_key FROM obs""", _OBS),
    "shard_assignment": _q(f"""SELECT ip, key, hash, CAST(hash % 128 AS INTEGER) AS partition FROM (SELECT ip, key,
      list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split(key, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, b: (xor(h, b) * 16777619) & 4294967295) AS hash
      FROM (SELECT DISTINCT ip, {_IP('ip')} AS key FROM obs))""", _OBS),
    "dedup_first": _q("SELECT *, sequence AS arrival FROM obs", _OBS),
    "dedup_against_seen": _q("SELECT * FROM obs WHERE sequence % 3 <> 0", _OBS),
    "dedup_with_ttl": f"""WITH RECURSIVE {_OBS},
      m AS (SELECT agent_id, sequence, t, sequence AS id FROM obs UNION ALL SELECT agent_id, sequence, t + 5000, sequence + 10000000 FROM obs WHERE sequence % 3 = 0
        UNION ALL SELECT agent_id, sequence, t + 9000, sequence + 20000000 FROM obs WHERE sequence % 4 = 0 UNION ALL SELECT agent_id, sequence, t + 12000, sequence + 30000000 FROM obs WHERE sequence % 6 = 0),
      n AS (SELECT *, row_number() OVER (PARTITION BY agent_id, sequence ORDER BY t, id) AS k FROM m),
      f AS (SELECT *, true AS claimed, t + 5400 AS until FROM n WHERE k = 1
        UNION ALL SELECT n.agent_id, n.sequence, n.t, n.id, n.k, n.t >= f.until, CASE WHEN n.t >= f.until THEN n.t + 5400 ELSE f.until END FROM f JOIN n ON n.agent_id = f.agent_id AND n.sequence = f.sequence AND n.k = f.k + 1)
      SELECT agent_id, sequence, t, id, claimed FROM f""",
    "prefix_counts_ipv6": _q("SELECT length, 2306139568115548160::BIGINT AS hi, CAST(network - 9223372036854775808 AS BIGINT) AS lo, hot_count FROM (SELECT CAST(length + 96 AS INTEGER) AS length, network::HUGEINT AS network, hot_count FROM counts WHERE length >= 8)", *_C),
    "high_water_mark": _q("""SELECT agent_id, first_gap - 1 AS mark, CAST((SELECT count(*) FROM seen s WHERE s.agent_id = g.agent_id AND s.sequence > g.first_gap) AS BIGINT) AS ahead FROM
      (SELECT agent_id, min(next) AS first_gap FROM (SELECT agent_id, sequence + 1 AS next FROM seen UNION SELECT agent_id, 0 FROM seen) c
       WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.agent_id = c.agent_id AND s.sequence = c.next) GROUP BY agent_id) g""", _OBS,
      "seen AS (SELECT agent_id, k AS sequence FROM (SELECT agent_id, row_number() OVER (PARTITION BY agent_id ORDER BY sequence) - 1 + CASE agent_id WHEN 'view' THEN 3 ELSE 0 END AS k, sequence FROM obs) WHERE k % 97 <> 50 UNION SELECT agent_id, 0 FROM obs WHERE agent_id = 'click')"),
    "coalesced_batches": _q("SELECT agent_id, sequence // 20 AS batch, ip, CAST(sum(request_count) AS BIGINT) AS request_count FROM obs GROUP BY ALL HAVING sum(request_count) > 0", _OBS),
    "batch_cost": _q("SELECT agent_id, sequence // 20 AS batch, count(DISTINCT ip) AS cost FROM obs GROUP BY ALL", _OBS),
    "agent_auth": _q("""SELECT sequence, agent_id, authenticated_as, CASE WHEN authenticated_as = 'error' THEN 'unknown' WHEN authenticated_as = 'purchase' THEN 'disabled' WHEN agent_id <> authenticated_as THEN 'mismatch'
      ELSE 'ok' END AS auth FROM (SELECT sequence, agent_id, CASE WHEN sequence % 25 = 0 THEN 'view' ELSE agent_id END AS authenticated_as FROM obs)""", _OBS),
    "lateness_outcomes": _q("SELECT sequence, t, now, outcome FROM classified", _OBS, _LATE),
    "outcome_counts": _q("SELECT outcome, count(*) AS n FROM classified GROUP BY outcome", _OBS, _LATE),
    "reconciliation_rows": _q("SELECT agent_id, sequence, ip, request_count, outcome FROM classified WHERE outcome <> 'applied'", _OBS, _LATE),
    "bucket_counts": _q("SELECT * FROM buckets", *_B),
    "sliding_window_total": _q("SELECT *, CAST(sum(requests) OVER (PARTITION BY ip ORDER BY bucket RANGE BETWEEN 169200 PRECEDING AND CURRENT ROW) AS BIGINT) AS total FROM buckets", *_B),
    "window_ticks": _q("SELECT * FROM ticks", *_B, _TICKS),
    "ip_state_timeline": _q("SELECT * FROM states", *_T),
    "ip_transitions": _q("SELECT ip, t, total, state FROM edges", *_T, _EDGES),
    "hot_ip_events": _q("SELECT ip, t, phase, shard, type, window_count, sequence, weight, attributes, config_version, event_id FROM hot_events", *_E),
    "shard_gauges": _q("SELECT CAST(ip % 8 AS INTEGER) AS shard, count(*) AS tracked, count(*) FILTER (WHERE total > 0) AS active, count(*) FILTER (WHERE state = 1) AS hot FROM current GROUP BY 1", *_N),
    "transition_counters": _q("SELECT shard, config_version, type, count(*) AS events FROM hot_events GROUP BY ALL", *_E),
    "transition_store": _q("""SELECT shard, count(*) FILTER (WHERE last = 'HotIpAdded') AS hot_ips, max(m) + 1 AS next_sequence FROM (SELECT shard, ip, arg_max(type, sequence) AS last, max(sequence) AS m FROM hot_events GROUP BY ALL) GROUP BY shard""", *_E),
    "cold_eviction_candidates": _q("SELECT ip, total, last_seen FROM current, moment WHERE state = 0 AND now + 300000 - last_seen >= 345600", *_N),
    "capacity_victims": _q("""SELECT shard, ip, last_seen, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY last_seen, ip) AS rank FROM
      (SELECT *, CAST(ip % 8 AS INTEGER) AS shard, count(*) OVER (PARTITION BY ip % 8) AS tracked FROM current) WHERE state = 0) WHERE rank <= tracked - 2""", *_N),
    "hot_set_current": _q("SELECT * FROM hot", *_H),
    "request_count_latest": _q("SELECT ip, CASE WHEN h.ip IS NOT NULL THEN 'HOT' ELSE 'COLD' END AS state, coalesce(h.request_count, 0) AS request_count FROM asked LEFT JOIN hot h USING (ip)", *_H, _ASKED).replace("h.ip IS NOT NULL", "h.request_count IS NOT NULL"),
    "attribute_bytes": _q("SELECT count(*) AS records, CAST(coalesce(sum(strlen(attributes)), 0) AS BIGINT) AS bytes FROM hot", *_H),
    "log_positions": _q("SELECT shard, max(t) AS as_of, max(sequence) + 1 AS event_sequence FROM log GROUP BY shard", *_E),
    "prefix_counts": _q("SELECT * FROM counts", *_C),
    "prefix_stats": _q("SELECT * FROM rated", *_S),
    "prefix_rollup_hierarchical": _q("SELECT * FROM counts WHERE length IN (24, 16, 8)", *_C),
    "total_hot": _q("SELECT (SELECT count(*) FROM counts) AS binary_nodes, (SELECT count(*) FROM hot) AS hot_ips, greatest(2 * (SELECT count(*) FROM hot) - 1, 0) AS compressed_nodes", *_C),
    "prefix_stats_changelog": _q("SELECT ip, t, phase, length, network, CAST(delta AS BIGINT) AS delta, hot_count, hot_ratio FROM classified_log", *_L),
    "latest_prefix_stats": _q("SELECT length, network, hot_count, t FROM last_rows", *_L),
    "hot_prefixes": _q("SELECT CAST(row_number() OVER (ORDER BY length DESC, network) AS INTEGER) AS position, length, network, prefix, hot_count AS hot_ips, capacity, hot_ratio, state FROM qualifying", *_S, _LISTED),
    "hot_prefixes_minimal": _q("SELECT CAST(row_number() OVER (ORDER BY length DESC, network) AS INTEGER) AS position, length, network, prefix, hot_count AS hot_ips, capacity, hot_ratio, state FROM least", *_S, _LISTED),
    "classification_changes": _q("SELECT length, network, t, phase, ip, hot_count, state FROM state_changes", *_L),
    "detections_since": _q(f"""SELECT CAST(row_number() OVER (ORDER BY length DESC, network) AS INTEGER) AS position, {_IP('network')} || '/' || length AS prefix, hot_count, CAST(1 AS BIGINT) << (32 - length) AS capacity,
      hot_count::DOUBLE / (CAST(1 AS BIGINT) << (32 - length))::DOUBLE AS hot_ratio, since, 'HOT_PREFIX' AS state FROM found""", *_L),
    "detection_gauges": _q("""SELECT (SELECT count(*) FROM found) AS hot_prefixes, (SELECT count(*) FROM found q WHERE NOT EXISTS (SELECT 1 FROM found x WHERE x.length > q.length AND (x.network >> (32 - q.length)) << (32 - q.length) = q.network))
      AS bot_network_candidates, (SELECT count(*) FROM state_changes) AS classification_changes""", *_L),
    "ancestor_counts": _q("SELECT ip, length, network, coalesce(hot_count, 0) AS hot_count FROM paths LEFT JOIN counts USING (length, network)", *_C, _ASKED, _PATHS),
    "longest_match": _q("""SELECT a.ip, b.length, b.network, b.hot_count FROM asked a LEFT JOIN (SELECT ip, length, network, hot_count, row_number() OVER (PARTITION BY ip ORDER BY length DESC) AS nth
      FROM paths JOIN counts USING (length, network)) b ON a.ip = b.ip AND b.nth = 1""", *_C, _ASKED, _PATHS),
    "prefix_containment": _q("SELECT sequence, ip FROM obs WHERE ip >> 4 = 169090576 >> 4", _OBS),
    "ip_view": _q(f"""SELECT ip, {_IP('ip')} AS address, CASE WHEN h.request_count IS NOT NULL THEN 'HOT' ELSE 'COLD' END AS state, coalesce(h.request_count, 0) AS request_count, h.attributes, m.matched
      FROM asked LEFT JOIN hot h USING (ip) JOIN matched m USING (ip)""", *_C, _ASKED, _PATHS, _MATCH),
    "prefix_view": _q(f"""SELECT length, network, prefix, hot_ips, capacity, hot_ratio, CASE WHEN hot_ips >= 16 AND hot_ratio >= 0.1::DOUBLE THEN 'HOT_PREFIX' ELSE 'NORMAL' END AS state FROM
      (SELECT length, network, {_IP('network')} || '/' || length AS prefix, coalesce(hot_count, 0) AS hot_ips, CAST(1 AS BIGINT) << (32 - length) AS capacity,
      coalesce(hot_count, 0)::DOUBLE / (CAST(1 AS BIGINT) << (32 - length))::DOUBLE AS hot_ratio FROM (SELECT DISTINCT length, network FROM paths WHERE length >= 8) LEFT JOIN counts USING (length, network))""", *_C, _ASKED, _PATHS),
    "metadata_local": _q(f"SELECT length, network, key, kind, {_FOLD} FROM declared GROUP BY length, network, key, kind", _DECLARED),
    "metadata_inherited": _q(f"SELECT own_length, own_network, key, kind, {_FOLD} FROM spots JOIN declared ON length < own_length AND (own_network >> (32 - length)) << (32 - length) = network GROUP BY own_length, own_network, key, kind", _DECLARED),
    "metadata_effective_prefix": _q(f"SELECT own_length, own_network, key, kind, {_FOLD} FROM spots JOIN declared ON length <= own_length AND (own_network >> (32 - length)) << (32 - length) = network GROUP BY own_length, own_network, key, kind", _DECLARED),
    "metadata_effective": _q(f"SELECT ip, key, kind, {_FOLD} FROM asked JOIN declared ON (ip >> (32 - length)) << (32 - length) = network GROUP BY ip, key, kind", _OBS, _ASKED, _DECLARED),
    "metadata_conflicts": _q("""SELECT DISTINCT a.length, a.network, a.key, a.kind, b.length AS other_length, b.kind AS other_kind FROM declared a JOIN declared b ON a.key = b.key AND a.kind <> b.kind AND b.length <= a.length
      AND (a.network >> (32 - b.length)) << (32 - b.length) = b.network""", _DECLARED),
    "config_reevaluation": _q("SELECT ip, t, phase, total, state, CASE WHEN is_new THEN 2 ELSE 1 END AS config_version FROM new_edges", *_B, _TICKS, _CHANGED),
    "config_versions": _q("""SELECT seen_at, config_version FROM (SELECT *, max(config_version) OVER (ORDER BY seen_at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM
      (SELECT sequence AS seen_at, (sequence * 37) % 1000 + sequence // 500 + 1 AS config_version FROM obs)) WHERE newest IS NULL OR config_version > newest""", _OBS),
    "rebucketed": _q("SELECT ip, bucket - bucket % 7200 AS bucket, CAST(sum(requests) AS BIGINT) AS requests FROM buckets GROUP BY 1, 2", *_B),
    "warm_up": _q("SELECT ip, t, phase, total, state FROM warm_edges", *_B, _TICKS, _WARM),
    "snapshot_plus_tail": _q("SELECT * FROM hot", *_H),
    "shard_merge": _q("SELECT * FROM counts WHERE length >= 8", *_C),
    "audit_counts": "SELECT 0::BIGINT AS violations, unnest(['counts', 'negative', 'orphans', 'hysteresis']) AS \"check\"",
    "audit_records": _q("SELECT ip + 1000000 AS ip, 'extra' AS problem FROM hot WHERE ip % 7 = 0 UNION ALL SELECT ip, 'missing' FROM hot WHERE ip % 7 = 0", *_H),
    "hot_prefix_walk": _q("SELECT length, network, hot_count, row_number() OVER (ORDER BY network, length) AS position FROM counts WHERE length >= 8", *_C),
    "declarations_order": _q("SELECT own_length AS length, own_network AS network, row_number() OVER (ORDER BY own_length, own_network) AS place FROM spots", _DECLARED),
    "canonical_attributes": """SELECT event_id, CASE WHEN event_id % 7 <> 0 AND event_id * 300 <= 1000000 THEN '{"attributes_version":1,"weight":' || event_id * 300 || ',"x_kind":"\\u00e9"}' END AS canonical FROM events""",
    "stream_equals_batch": _q("SELECT ip, t, phase, total, state FROM edges, moment WHERE t <= now", *_E),
    "rate_limit_decisions": f"""WITH RECURSIVE {_OBS},
      every AS (SELECT agent_id, t, sequence AS id, sequence % 13 - 1 AS cost FROM obs),
      calls AS (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY t, id) AS n FROM every WHERE cost BETWEEN 1 AND 10),
      folded AS (SELECT agent_id, n, t, id, cost, true AS allowed, 10.0::DOUBLE - cost AS tokens FROM calls WHERE n = 1
        UNION ALL SELECT agent_id, n, t, id, cost, filled >= cost, CASE WHEN filled >= cost THEN filled - cost ELSE filled END FROM
        (SELECT c.*, least(10.0::DOUBLE, f.tokens + greatest(c.t - f.t, 0) * 0.002::DOUBLE) AS filled FROM folded f JOIN calls c ON c.agent_id = f.agent_id AND c.n = f.n + 1))
      SELECT e.agent_id, e.t, e.id, e.cost, f.allowed, CASE WHEN f.id IS NULL THEN 'cost' END AS problem, CASE WHEN NOT f.allowed THEN CAST(greatest(1, ceil((e.cost - f.tokens) / 0.002::DOUBLE)) AS INTEGER) END AS retry_after
      FROM every e LEFT JOIN folded f ON f.agent_id = e.agent_id AND f.id = e.id""",
    "lease_history": f"""WITH RECURSIVE {_OBS},
      requests AS (SELECT ip % 4 AS shard, t, sequence AS id, agent_id AS owner, CASE WHEN sequence % 3 = 0 THEN 'release' ELSE 'acquire' END AS action, row_number() OVER (PARTITION BY ip % 4 ORDER BY t, sequence) AS n FROM obs),
      folded AS (SELECT shard, n, t, id, owner, action, action = 'acquire' AS granted, CASE WHEN action = 'acquire' THEN owner END AS holder, CASE WHEN action = 'acquire' THEN t + 7200 ELSE 0 END AS until FROM requests WHERE n = 1
        UNION ALL SELECT shard, n, t, id, owner, action, granted, CASE WHEN granted AND action = 'acquire' THEN owner WHEN granted THEN NULL ELSE holder END, CASE WHEN granted AND action = 'acquire' THEN t + 7200 ELSE until END FROM
        (SELECT r.*, f.holder, f.until, CASE WHEN r.action = 'acquire' THEN f.holder IS NULL OR f.until <= r.t OR f.holder = r.owner ELSE f.holder IS NOT NULL AND f.until > r.t AND f.holder = r.owner END AS granted
         FROM folded f JOIN requests r ON r.shard = f.shard AND r.n = f.n + 1))
      SELECT shard, t, id, owner, action, granted FROM folded""",
}
