"""SQL for the corpus queries that SQL can express, for DuckDB."""

from __future__ import annotations

# One row for each turn, with the mark that the template puts before it.
CHAT = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) r(i)
), marked AS (
  SELECT *, lag(role) OVER w IS DISTINCT FROM role OR row_number() OVER w = 1 AS is_first,
    replace(replace(replace(text, '\', '\\'), '</', '<\/'), '###', '\###') AS escaped,
    replace(replace(replace(replace(role, '\', '\\'), '</', '<\/'), '###', '\###'), ':', '\:') AS name
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  cast(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS bigint) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  cast(sum(CASE WHEN is_first THEN 6 + length(name) ELSE 2 END + length(escaped) + 8) AS bigint) AS formatted_chars
FROM marked GROUP BY conv_id
"""

# Every pair that shares a shingle is counted, and links are followed to the least id.
NEAR_DUPLICATES = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), lists AS (
  SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words
), sizes AS (SELECT doc_id, coalesce(len(s), 0) AS n FROM lists), flat AS (SELECT doc_id, unnest(s) AS g FROM lists),
links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM flat x JOIN flat y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN sizes p1 ON p1.doc_id = a JOIN sizes p2 ON p2.doc_id = b WHERE 100 * c >= 80 * (p1.n + p2.n - c)
), reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT doc_id, cast(n AS bigint) AS n_shingles, coalesce(least(doc_id, (SELECT min(b) FROM reach WHERE a = doc_id)), doc_id) AS component_id,
  coalesce((SELECT min(b) FROM reach WHERE a = doc_id) >= doc_id, true) AS kept FROM sizes
"""

EMBEDDINGS = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, cast(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= 0.95
), reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, coalesce(least(vec_id, (SELECT min(b) FROM reach WHERE a = vec_id)), vec_id) AS component_id,
  coalesce((SELECT min(b) FROM reach WHERE a = vec_id) >= vec_id, true) AS kept FROM embeddings
"""
