"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_LOW = "translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPACED = r"[^\x20\x09-\x0D]+"

CONTAMINATION = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, '{_ALNUM}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOW}, '{_ALNUM}') AS w FROM benchmark),
bi AS (SELECT item_id, w, LEAST(13, LEN(w)) AS l, UNNEST(RANGE(1, LEN(w) - LEAST(13, LEN(w)) + 2)) AS i FROM b WHERE LEN(w) > 0),
bw AS (SELECT DISTINCT item_id, l, ARRAY_TO_STRING(w[i : i + l - 1], ' ') AS g FROM bi),
di AS (SELECT doc_id, w, l, UNNEST(RANGE(1, LEN(w) - l + 2)) AS i FROM d, (SELECT DISTINCT l FROM bw) WHERE LEN(w) >= l),
dw AS (SELECT doc_id, i, l, ARRAY_TO_STRING(w[i : i + l - 1], ' ') AS g FROM di),
hits AS (SELECT doc_id, i, dw.l, item_id FROM dw JOIN bw ON dw.l = bw.l AND dw.g = bw.g),
cov AS (SELECT doc_id, COUNT(DISTINCT p) AS n_hit FROM (SELECT doc_id, UNNEST(RANGE(i, i + l)) AS p FROM hits) GROUP BY 1),
ids AS (SELECT doc_id, LIST_SORT(LIST(DISTINCT CAST(item_id AS VARCHAR))) AS ids FROM hits GROUP BY 1)
SELECT d.doc_id, LEN(w) AS n_words, COALESCE(n_hit, 0) AS n_hit, COALESCE(LEN(ids), 0) AS n_items, sha256(COALESCE(ARRAY_TO_STRING(ids, ','), '')) AS items_sha256,
 COALESCE(n_hit, 0) > 0 AND 20 * COALESCE(n_hit, 0) >= LEN(w) AS contaminated
FROM d LEFT JOIN cov ON cov.doc_id = d.doc_id LEFT JOIN ids ON ids.doc_id = d.doc_id
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOW}, '{_SPACED}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, ARRAY_TO_STRING(w[i : i + 2], ' ') AS g FROM (SELECT doc_id, w, UNNEST(RANGE(1, GREATEST(1, LEN(w) - 2) + 1)) AS i FROM d WHERE LEN(w) > 0)),
n AS (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 85 * (x.n + y.n - m)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.x, t.b FROM r JOIN both_ways t ON r.y = t.a),
k AS (SELECT x, MIN(y) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, COALESCE(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d JOIN k ON k.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

SUBSTRINGS = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(COALESCE(text, ''), '{_SPACED}') AS w FROM documents),
x AS (SELECT doc_id, i, ARRAY_TO_STRING(w[i : i + 34], ' ') AS g FROM (SELECT doc_id, w, UNNEST(RANGE(1, LEN(w) - 33)) AS i FROM d WHERE LEN(w) >= 35)),
r AS (SELECT g FROM x GROUP BY g HAVING COUNT(*) > 1),
p AS (SELECT doc_id, LIST(DISTINCT p) AS gone FROM (SELECT doc_id, UNNEST(RANGE(i, i + 35)) AS p FROM x JOIN r USING (g)) GROUP BY 1)
SELECT d.doc_id, LEN(w) AS n_words, COALESCE(LEN(gone), 0) AS n_removed,
 sha256(ARRAY_TO_STRING(CASE WHEN gone IS NULL THEN w ELSE LIST_FILTER(w, lambda y, i: NOT LIST_CONTAINS(gone, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN p ON p.doc_id = d.doc_id
"""

CHAT = r"""
WITH c AS (SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
 UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, LENGTH(regexp_replace(regexp_replace(text, '<(\\*/?s>)', '<\\\1', 'g'), '\[(\\*/?(INST|SYS|ROLE)\])', '[\\\1', 'g')) AS t,
 LENGTH(regexp_replace(regexp_replace(role, '<(\\*/?s>)', '<\\\1', 'g'), '\[(\\*/?(INST|SYS|ROLE)\])', '[\\\1', 'g')) AS r FROM c)
SELECT conv_id, COUNT(*) AS n_turns, sha256(STRING_AGG(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 CAST(COALESCE(SUM(LENGTH(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
 sha256(COALESCE(STRING_AGG(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
 CAST(3 + SUM(t + CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 13 WHEN 'assistant' THEN 5 ELSE 20 + r END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
