"""SQL of the corpus queries that SQL can express, for whole tables."""

from __future__ import annotations

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS phrase
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
spots AS (SELECT r, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS phrase FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
found AS (SELECT r, item, n, i FROM spots JOIN win USING (n, phrase)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM found) GROUP BY r),
named AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM found GROUP BY r),
pos AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p, len(w) AS n_words FROM d WHERE len(w) > 0),
freq AS (SELECT x, count(*) AS f FROM pos GROUP BY x),
owned AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, list_slice(w, i, i + least(len(w), 10) - 1) AS t FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
numbered AS (SELECT t, row_number() OVER () AS k FROM (SELECT DISTINCT t FROM owned)),
term AS (SELECT k, len(t) AS n, unnest(t) AS x, unnest(range(0, len(t))) AS o FROM numbered),
ranked AS (SELECT term.*, row_number() OVER (PARTITION BY k ORDER BY f, o) AS place, count(*) OVER (PARTITION BY k) AS have FROM term JOIN freq USING (x)),
proposed AS (SELECT DISTINCT r, k, ranked.n, p - o AS s FROM ranked JOIN pos USING (x) WHERE place = 1 AND have = ranked.n AND p - o >= 1 AND p - o + ranked.n - 1 <= n_words),
close AS (SELECT c.r, c.k, c.s, c.n FROM proposed c JOIN ranked t ON t.k = c.k AND t.place > 1 JOIN pos q ON q.r = c.r AND q.x = t.x AND q.p BETWEEN c.s + t.o - 1 AND c.s + t.o + 1
  GROUP BY ALL HAVING count(DISTINCT t.o) = c.n - 1 UNION ALL SELECT r, k, s, n FROM proposed WHERE n = 1),
near_hit AS (SELECT r, count(DISTINCT p) AS n_near_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM close) GROUP BY r),
near_named AS (SELECT r, count(DISTINCT item) AS n_near_items FROM close JOIN numbered USING (k) JOIN owned USING (t) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
  coalesce(n_near_hit, 0) AS n_near_hit, coalesce(n_near_items, 0) AS n_near_items
FROM d LEFT JOIN hit USING (r) LEFT JOIN named USING (r) LEFT JOIN near_hit USING (r) LEFT JOIN near_named USING (r)
"""

NEAR_DUPLICATES = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(list_slice(w, i, i + 3), ' ') AS x FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS size, md5(string_agg(x, chr(10) ORDER BY x)) AS same FROM s GROUP BY r),
one AS (SELECT same, min(r) AS r, any_value(size) AS size FROM n GROUP BY same),
t AS (SELECT s.r, s.x, one.size FROM s JOIN one USING (r)),
pairs AS (SELECT a.r AS a, b.r AS b, any_value(a.size) + any_value(b.size) AS total, count(*) AS shared FROM t a JOIN t b ON a.x = b.x AND a.r < b.r AND 100 * least(a.size, b.size) >= 85 * greatest(a.size, b.size) GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs WHERE 100 * shared >= 85 * (total - shared)),
step AS (SELECT a AS u, b AS v FROM links UNION SELECT b, a FROM links),
reach AS (SELECT r AS u, r AS v FROM one UNION SELECT reach.u, step.v FROM reach JOIN step ON reach.v = step.u),
least_id AS (SELECT one.same, min(d.doc_id) AS doc FROM one JOIN n USING (same) JOIN d ON d.r = n.r GROUP BY one.same),
names AS (SELECT o.same, min(l.doc) AS component_id FROM one o JOIN reach ON reach.u = o.r JOIN one p ON p.r = reach.v JOIN least_id l ON l.same = p.same GROUP BY o.same)
SELECT d.doc_id, coalesce(n.size, 0) AS n_shingles, CASE WHEN n.r IS NULL THEN d.doc_id ELSE names.component_id END AS component_id
FROM d LEFT JOIN n ON n.r = d.r LEFT JOIN names USING (same)
"""

CHAT = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, * FROM (VALUES (0, 'user', '</s>[INST] ok [/INST]'), (1, 'assistant', '</s>[INST] ok [/INST]'))),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
  length(text) + length(text) - length(translate(text, '\[]<', '')) + CASE role WHEN 'user' THEN 14 WHEN 'system' THEN 16 WHEN 'assistant' THEN 5
  ELSE 15 + length(role) + length(role) - length(translate(role, '\[]<', '')) END AS chars FROM c),
p AS (SELECT *, 3 + sum(chars) OVER (PARTITION BY conv_id ORDER BY k) AS so_far, max(CASE WHEN role = 'assistant' THEN k ELSE 0 END) OVER (PARTITION BY conv_id) AS last_target, count(*) OVER (PARTITION BY conv_id) AS turns FROM n)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(so_far) FILTER (WHERE role = 'assistant' OR (k = turns AND last_target < turns)) AS BIGINT) AS formatted_chars,
  count(*) FILTER (WHERE role = 'assistant' OR (k = turns AND last_target < turns)) AS n_examples
FROM p GROUP BY conv_id
"""

URL_FILTER = r"""
WITH RECURSIVE rules(rule, says) AS (VALUES ('org/', 'allow'), ('example.org/es/', 'block'), ('example.org/en/1', 'block'), ('com/fr/', 'allow'), ('com/de/', 'block')),
p AS (SELECT row_number() OVER () AS r, page_id, html, coalesce(translate(regexp_extract(url, '(?s)\A.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '(?s)\A.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
fits AS (SELECT r, arg_max(rule, length(rule)) AS rule, arg_max(says, length(rule)) AS says FROM p JOIN rules ON (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1)))
  AND starts_with(path, substr(rule, strpos(rule, '/'))) GROUP BY r),
seeds AS (SELECT CASE says WHEN 'allow' THEN 'trust' ELSE 'distrust' END AS kind, host, count(*)::DOUBLE AS value FROM p JOIN fits USING (r) GROUP BY 1, 2),
origin AS (SELECT kind, host, value / sum(value) OVER (PARTITION BY kind) AS value FROM seeds),
hrefs AS (SELECT host AS src, unnest(list_distinct(regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*["'']?([^"''\s>]+)', 1))) AS href FROM p),
edges AS (SELECT src, dst, count(*) AS links FROM (SELECT src, translate(regexp_extract(CASE WHEN starts_with(href, '//') THEN 'http:' || href ELSE href END, '(?s)\A.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst FROM hrefs)
  WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY 1, 2),
flow AS (SELECT 'trust' AS kind, src AS host, dst AS target, links / sum(links) OVER (PARTITION BY src) AS share FROM edges UNION ALL SELECT 'distrust', dst, src, links / sum(links) OVER (PARTITION BY dst) FROM edges),
steps AS (SELECT 0 AS i, kind, host, value FROM origin UNION ALL SELECT i, kind, host, sum(value) FROM
  (SELECT s.i + 1 AS i, f.kind, f.target AS host, 0.85::DOUBLE * s.value * f.share AS value FROM steps s JOIN flow f ON s.kind = f.kind AND s.host = f.host WHERE s.i < 20
   UNION ALL SELECT n.i + 1, o.kind, o.host, 0.15::DOUBLE * o.value FROM (SELECT DISTINCT i FROM steps WHERE i < 20) n, origin o WHERE EXISTS (SELECT 1 FROM flow)) GROUP BY i, kind, host),
ranks AS (SELECT host, sum(CASE WHEN kind = 'trust' THEN value ELSE 0 END) AS trust, sum(CASE WHEN kind = 'distrust' THEN value ELSE 0 END) AS distrust FROM steps WHERE i = (SELECT max(i) FROM steps) GROUP BY host)
SELECT page_id, p.host, path, fits.rule, coalesce(fits.says, CASE WHEN distrust > trust THEN 'block' ELSE 'allow' END, 'allow') AS verdict, coalesce(trust, 0) AS trust, coalesce(distrust, 0) AS distrust
FROM p LEFT JOIN fits USING (r) LEFT JOIN ranks ON ranks.host = p.host
"""
