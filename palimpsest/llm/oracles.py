"""SQL, as DuckDB runs it, of operators that SQL can express on small tables."""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+')"

OP2_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), steps AS (
  SELECT *, lag(role) OVER w AS before, lead(role) OVER w AS after FROM turns
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), judged AS (
  SELECT *, CASE
      WHEN before IS NULL THEN role IN ('system', 'user')
      WHEN before = 'system' THEN role = 'user'
      WHEN before = 'user' THEN role = 'assistant'
      WHEN before = 'assistant' THEN role IN ('user', 'tool')
      WHEN before = 'tool' THEN role IN ('assistant', 'tool') ELSE false END AND (after IS NOT NULL OR role = 'assistant') AS fits,
    CASE role WHEN 'system' THEN 14 WHEN 'user' THEN 16 WHEN 'assistant' THEN 12 WHEN 'tool' THEN 16 ELSE 21 + length(role) END
      + length(text) + len(regexp_extract_all(text, '<\\*/?s>|\[\\*/?(?:SYS|INST|TOOL|ROLE)\]|\[\\*(?:ANS|END)\]')) AS chars
  FROM steps
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars, bool_and(fits) AS valid
FROM judged GROUP BY conv_id
"""

OP3_SQL = rf"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t-\r]+') AS w FROM documents
), shingled AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM worded
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingled GROUP BY doc_id
), links AS (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM shingled x JOIN shingled y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN sizes m ON m.doc_id = p.a JOIN sizes o ON o.doc_id = p.b WHERE 100 * common >= 85 * (m.n + o.n - common)
), reached(id, r) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT reached.id, links.b FROM reached JOIN links ON reached.r = links.a
)
SELECT d.doc_id, coalesce(any_value(s.n), 0) AS n_shingles, min(r.r) AS component_id, min(r.r) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN reached r ON r.id = d.doc_id GROUP BY d.doc_id
"""

OP7_SQL = rf"""
WITH worded AS (
  SELECT doc_id, {_WORDS} AS w FROM documents
), placed AS (
  SELECT doc_id, i, w[i] AS word, CASE WHEN i + 34 <= len(w) THEN array_to_string(w[i:i + 34], ' ') END AS run
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM worded)
), counted AS (
  SELECT doc_id, i, word, CAST(run IS NOT NULL AND count(*) OVER (PARTITION BY run) > 1 AS INTEGER) AS again FROM placed
), covered AS (
  SELECT doc_id, i, word, max(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM counted
)
SELECT d.doc_id, count(c.i) AS n_words, CAST(coalesce(sum(gone), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0), '')) AS kept_sha256
FROM documents d LEFT JOIN covered c ON c.doc_id = d.doc_id GROUP BY d.doc_id
"""

OP9_SQL = """
WITH RECURSIVE usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95
), reached(id, r) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT reached.id, links.b FROM reached JOIN links ON reached.r = links.a
)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE a = e.vec_id) AS n_links, min(r.r) AS component_id, min(r.r) = e.vec_id AS kept
FROM embeddings e JOIN reached r ON r.id = e.vec_id GROUP BY e.vec_id
"""

#: For pages as the tables have them: one article, in which nothing is beside it, with the few references named here.
OP4_SQL = r"""
WITH articles AS (
  SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article[^>]*>(.*?)(?:</article>|\z)', 1), '(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>', '', 'g') AS article FROM pages
), parts AS (
  SELECT page_id, url, string_split(regexp_replace(regexp_replace(article, '<br[^>]*>', ' ', 'g'), '</?(?:p|h[1-6]|div|section|ul|ol|li|blockquote|table|tr|td|th|pre)(?:[ /][^>]*)?>', chr(30), 'g'), chr(30)) AS part FROM articles
), blocks AS (
  SELECT page_id, url, i, trim(regexp_replace(replace(replace(replace(regexp_replace(regexp_replace(part[i], '<[/!?a-zA-Z][^>]*(?:>|\z)', '', 'g'),
    '&quot;?', '"', 'g'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '[\s\x{A0}]+', ' ', 'g')) AS block
  FROM (SELECT page_id, url, part, unnest(range(1, len(part) + 1)) AS i FROM parts)
), texts AS (
  SELECT page_id, url, coalesce(string_agg(replace(block, '&amp', '&'), chr(10) ORDER BY i) FILTER (WHERE block <> ''), '') AS text FROM blocks GROUP BY page_id, url
)
SELECT page_id, url, text, length(text) AS n_chars FROM texts
"""
