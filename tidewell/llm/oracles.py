"""DuckDB SQL with the rows of those queries that SQL can express."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP2 = rf"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []::VARCHAR[]) AS w
  FROM documents),
i AS (
  SELECT item_id, coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []::VARCHAR[]) AS w
  FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[s : s + n - 1], ' ') AS g
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS s
        FROM (SELECT item_id, w, least(13, len(w)) AS n FROM i WHERE len(w) > 0))),
dw AS (
  SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s
        FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
hit AS (SELECT doc_id, s, dw.n, item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.g = iw.g),
words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT doc_id, s, n FROM hit)) GROUP BY 1),
ids AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS l
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN ids USING (doc_id)
"""

OP4_JUNK = r"(?i)(?:^|[^a-z0-9])(?:casino|poker|porn|xxx|viagra|doubleclick|adserver|banner|popunder|torrent|warez|free[-_.]download)(?:[^a-z0-9]|$)|/wp-login\.php(?:[^a-z0-9]|$)"
OP4 = rf"""
WITH p AS (
  SELECT page_id,
         CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') ELSE '' END AS host,
         CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
rules(rule, h, t, v) AS (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'), ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
best AS (
  SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, arg_max(v, length(rule)) AS v
  FROM p LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, t)
  GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN regexp_matches(host || path, '{OP4_JUNK}') THEN 'block' ELSE 'allow' END) AS verdict
FROM best
"""

OP6 = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []::VARCHAR[]) AS w FROM documents),
g AS (SELECT doc_id, s, array_to_string(w[s : s + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS s FROM d)),
lead AS (SELECT g, min(doc_id) AS first_doc FROM g GROUP BY 1 HAVING count(DISTINCT doc_id) > 1),
gone AS (SELECT doc_id, list(DISTINCT p) AS p FROM (SELECT doc_id, unnest(range(s, s + 13)) AS p FROM g JOIN lead USING (g) WHERE doc_id > first_doc) GROUP BY 1),
numbered AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
left_over AS (
  SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY numbered.p) AS t
  FROM numbered ANTI JOIN (SELECT doc_id, unnest(p) AS p FROM gone) q USING (doc_id, p) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN left_over USING (doc_id)
"""

OP11 = r"""
WITH m AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, k, if(k = 0, 'user', 'assistant'), '</s>[INST] ok [/INST]' FROM range(2) t(k)),
e AS (
  SELECT *, regexp_replace(role, '([<\[])(\\*)(\|[A-Za-z0-9_]{1,32}\|>|/?s>|/?INST\])', '\1\\\2\3', 'g') AS head,
    regexp_replace(text, '([<\[])(\\*)(\|[A-Za-z0-9_]{1,32}\|>|/?s>|/?INST\])', '\1\\\2\3', 'g') AS body FROM m)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, body)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, body) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(head) + length(body) + length('<|turn|><|text|><|end|>'))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

OP12 = r"""
WITH d AS (
  SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT d, lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS t FROM d),
q AS (SELECT row_number() OVER () AS q, lang, regexp_extract_all(t, '[^\x20\x09]+') AS w FROM p),
one AS MATERIALIZED (SELECT q, lang, unnest(w) AS x, unnest(range(len(w))) AS i FROM q),
total AS (SELECT lang, count(*) AS n FROM one GROUP BY 1),
grams AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS g
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM q, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k)),
f AS MATERIALIZED (SELECT lang, k, g, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
cuts AS (
  SELECT lang, g, k, f AS a, c, array_to_string(string_split(g, ' ')[1 : c], ' ') AS lg, array_to_string(string_split(g, ' ')[c + 1 :], ' ') AS rg
  FROM (SELECT *, unnest(range(1, k)) AS c FROM f WHERE k > 1)),
s AS (
  SELECT cuts.lang, cuts.g, a, c, l.f AS l, r.f AS r, n, (1000::HUGEINT * a * n) // (l.f::HUGEINT * r.f) AS score
  FROM cuts JOIN f l ON l.lang = cuts.lang AND l.g = lg JOIN f r ON r.lang = cuts.lang AND r.g = rg JOIN total ON total.lang = cuts.lang),
low AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, c) = 1),
inner_ AS (
  SELECT lang, f, array_to_string(string_split(g, ' ')[i : i + m - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM f WHERE k > 2))),
kept AS (SELECT * FROM low WHERE NOT EXISTS (SELECT 1 FROM inner_ x WHERE x.lang = low.lang AND x.g = low.g AND 100 * x.f >= 100 * low.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank FROM kept)
SELECT lang, rank, g AS phrase, a, l, r, n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""

OP13 = r"""
WITH RECURSIVE f AS (
  SELECT row_number() OVER () AS k, doc_id, source, doc_id::VARCHAR AS i, lang, n_chars::VARCHAR AS c, text FROM documents),
crc AS (
  SELECT k, xor(4294967295, list_reduce(list_transform(string_split(i, ''), lambda x: ascii(x)::BIGINT), lambda a, b:
    list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda p, q: CASE WHEN p & 1 = 1 THEN xor(p >> 1, 3988292384) ELSE p >> 1 END), 4294967295)) AS crc
  FROM f WHERE i IS NOT NULL),
t AS (SELECT f.*, CASE WHEN crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS changed FROM f LEFT JOIN crc USING (k)),
leaf AS (
  SELECT k, doc_id, source,
    sha256(concat(coalesce(strlen(i) || ':' || i, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(c) || ':' || c, '-'), coalesce(strlen(text) || ':' || text, '-'))) AS leaf,
    sha256(concat(coalesce(strlen(i) || ':' || i, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(c) || ':' || c, '-'), coalesce(strlen(changed) || ':' || changed, '-'))) AS changed
  FROM t),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS sid FROM leaf),
own(sid, level, nodes) AS (
  SELECT sid, 0, list(leaf ORDER BY pos) FROM placed GROUP BY sid
  UNION ALL
  SELECT sid, level + 1, list_transform(range(0, (len(nodes) + 2) // 3), lambda g: sha256(array_to_string(nodes[3 * g + 1 : 3 * g + 3], ''))) FROM own WHERE len(nodes) > 1),
sub AS (SELECT sid, nodes[1] AS subroot, level AS depth FROM own WHERE len(nodes) = 1),
top(level, nodes) AS (
  SELECT 0, list(subroot ORDER BY sid) FROM sub
  UNION ALL
  SELECT level + 1, list_transform(range(0, (len(nodes) + 2) // 3), lambda g: sha256(array_to_string(nodes[3 * g + 1 : 3 * g + 3], ''))) FROM top WHERE len(nodes) > 1),
root AS (SELECT nodes[1] AS root FROM top WHERE len(nodes) = 1),
steps AS (
  SELECT k, level, nodes, (pos // (3 ** level)::BIGINT) AS ix FROM placed JOIN own USING (sid) WHERE len(nodes) > 1
  UNION ALL
  SELECT k, depth + top.level, nodes, (sid // (3 ** top.level)::BIGINT) FROM placed JOIN sub USING (sid), top WHERE len(nodes) > 1),
sides AS (SELECT k, level, array_to_string(nodes[3 * (ix // 3) + 1 : ix], '') AS l, array_to_string(nodes[ix + 2 : 3 * (ix // 3) + 3], '') AS r FROM steps),
proof AS (SELECT k, string_agg(l || r, '' ORDER BY level) AS p FROM sides GROUP BY k),
fold(k, level, a) AS (
  SELECT k, 0, changed FROM leaf
  UNION ALL
  SELECT k, fold.level + 1, sha256(l || a || r) FROM fold JOIN sides USING (k, level)),
folded AS (SELECT k, arg_max(a, level) AS folded_root FROM fold GROUP BY k)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(p, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM placed JOIN sub USING (sid) JOIN folded USING (k) LEFT JOIN proof USING (k), root
"""

ORACLES = {"op2_decontamination": OP2, "op4_url_filters": OP4, "op6_substring_dedup": OP6, "op11_chat_formatting": OP11, "op12_collocations": OP12, "op13_merkle_manifest": OP13}
