"""SQL for DuckDB of the queries that SQL can express. op1, op2, op3, op6 and op9 hash, index or train beyond it."""

from __future__ import annotations

from . import rules

OP4_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
kinds(rank, kind, pattern) AS (VALUES
  (0, 'assign', '(?i)(?:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+'),
  (1, 'access', 'AKIA[A-Z0-9]+'), (2, 'hex', '[0-9a-f]+'), (3, 'token', '[A-Za-z0-9+/_=-]+')),
found AS (
  SELECT r, doc_id, source, rank, kind, pattern, unnest(regexp_extract_all(text, pattern)) AS match,
         unnest(string_split_regex(text, pattern)[:-2]) AS gap, unnest(range(len(regexp_extract_all(text, pattern)))) AS i
  FROM docs, kinds WHERE regexp_matches(text, pattern)),
placed AS (
  SELECT *, CAST(sum(len(gap) + len(match)) OVER (PARTITION BY r, rank ORDER BY i ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop,
         CASE rank WHEN 0 THEN regexp_extract(match, '(?i)^(?:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1) ELSE match END AS value
  FROM found),
spans AS (
  SELECT r, doc_id, source, rank, kind, stop - len(match) AS start, stop, value FROM placed
  WHERE CASE rank WHEN 0 THEN len(value) >= 12 WHEN 1 THEN len(value) >= 18 WHEN 2 THEN len(value) >= 16
        ELSE len(value) >= 20 AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') END),
known AS (
  SELECT value, count(*) AS owners, CAST(sum(n) AS BIGINT) AS repositories FROM (
    SELECT value, source, count(*) AS n FROM (SELECT DISTINCT value, source, doc_id FROM spans) GROUP BY value, source) GROUP BY value),
judged AS (SELECT s.*, k.owners, k.repositories, k.owners <= 2 AND k.repositories <= 20 AS live FROM spans s JOIN known k USING (value)),
kept AS (
  SELECT * FROM judged t WHERE rank < 3
  UNION ALL
  SELECT * FROM judged t WHERE rank = 3 AND live AND NOT EXISTS (
    SELECT 1 FROM judged b WHERE b.r = t.r AND b.rank < 3 AND b.start <= t.start AND b.stop >= t.stop)),
told AS (
  SELECT r, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
         coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < 3), '') AS base,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans,
         count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_copied, max(owners) AS owners, max(repositories) AS repositories
  FROM kept GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live,
       coalesce(n_copied, 0) AS n_copied, coalesce(owners, 0) AS owners, coalesce(repositories, 0) AS repositories
FROM docs LEFT JOIN told USING (r)
"""

OP5_SQL = r"""
WITH words AS (
  SELECT doc_id, generate_subscripts(w, 1) - 1 AS i, unnest(w) AS word
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents)),
windows AS (
  SELECT doc_id, i, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS body,
         count(*) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS n
  FROM words),
hit AS (SELECT doc_id, i, row_number() OVER (PARTITION BY body ORDER BY doc_id, i) > 1 AS again FROM windows WHERE n = 20),
marked AS (
  SELECT w.doc_id, w.i, w.word,
         coalesce(max(CAST(again AS INT)) OVER (PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0) = 1 AS gone
  FROM words w LEFT JOIN hit h ON h.doc_id = w.doc_id AND h.i = w.i),
done AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept
  FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN done USING (doc_id)
"""

#: Of op6 what does not hash vectors: the sizes and the edited texts' digests.
EDITS_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
beside AS (
  SELECT doc_id, text, coalesce(lead(text) OVER o, first_value(text) OVER o) AS following
  FROM docs WINDOW o AS (ORDER BY doc_id DESC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT doc_id, len(text) AS n_chars, sha256(left(text, len(text) - len(text) // 3) || left(following, len(text) // 3)) AS edited_sha256
FROM beside
"""

OP7_SQL = (
    r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS text FROM documents),
split AS (
  SELECT r, doc_id, lang, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM docs),
words AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM split),
runs AS (SELECT r, i, count(*) OVER (PARTITION BY r, word, second, third) > 1 AS again FROM (
  SELECT r, i, word, lead(word) OVER o AS second, lead(word, 2) OVER o AS third FROM words WINDOW o AS (PARTITION BY r ORDER BY i)) WHERE third IS NOT NULL),
repeated AS (SELECT r, count(DISTINCT i + k) AS n FROM runs, range(3) t(k) WHERE again GROUP BY r),
counts AS (
  SELECT s.r, doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: len(x))), 0) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         coalesce(n, 0) AS n_repeat_words, len(lines) AS n_lines, len(list_filter(w, lambda x: NOT regexp_matches(x, '[0-9A-Za-z]|[^\x00-\x7F]'))) AS n_bare,
         len(regexp_extract_all(text, '[A-Z]')) AS n_upper, len(regexp_extract_all(text, '[A-Za-z]|[^\x00-\x7F]')) AS n_letters, len(regexp_extract_all(text, '!')) AS n_marks
  FROM split s LEFT JOIN repeated USING (r)),
measured AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         [n_symbols / greatest(word_chars, 1), n_dup_lines / greatest(n_lines, 1), n_repeat_words / greatest(n_words, 1),
          n_bare / greatest(n_words, 1), n_upper / greatest(n_letters, 1), n_marks / greatest(n_words, 1)] AS ratios
  FROM counts),
good AS (
  SELECT m.* FROM measured m JOIN (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1) l USING (doc_id)
  WHERE NOT base_failed),
strata AS (SELECT lang, count(*) AS n FROM good GROUP BY lang),
grid AS (SELECT unnest(GRID) AS c, generate_subscripts(GRID, 1) AS pos),
tried AS (
  SELECT g.lang, rule, pos, c, any_value(s.n) AS n, count(*) FILTER (ratios[rule] > c) AS k
  FROM good g JOIN strata s ON g.lang IS NOT DISTINCT FROM s.lang, grid, range(1, 7) t(rule) GROUP BY g.lang, rule, pos, c),
judged AS (
  SELECT *, k / n <= RISK AND list_sum(list_transform(range(0, k + 1), lambda i: 
         exp(lgamma(n + 1) - CASE WHEN i = 0 THEN 0 ELSE lgamma(i + 1) END - lgamma(n - i + 1) + i * ln(RISK) + (n - i) * ln(1 - RISK)))) <= ERROR / (6 * (SELECT count(*) FROM strata)) AS safe
  FROM tried),
walked AS (SELECT lang, rule, coalesce(min(pos) FILTER (NOT safe), 1000) AS ends FROM judged GROUP BY lang, rule),
cuts AS (SELECT w.lang, w.rule, min(c) AS cutoff FROM walked w JOIN grid ON pos < ends GROUP BY w.lang, w.rule),
rejected AS (SELECT DISTINCT m.r FROM measured m JOIN cuts c ON m.lang IS NOT DISTINCT FROM c.lang AND m.ratios[c.rule] > c.cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND r NOT IN (SELECT r FROM rejected) AS kept
FROM measured
""".replace("GRID", str(list(rules.GRID))).replace("RISK", f"{rules.RISK}::DOUBLE").replace("ERROR", f"{rules.ERROR}::DOUBLE")
)

OP8_SQL = r"""
WITH given AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
sized AS (SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest, sha256(payload) AS key FROM given),
kept AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY key) ELSE page_id END AS keep FROM sized)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN keep IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN keep IS DISTINCT FROM page_id THEN keep END AS refers_to
FROM kept
"""

OP10_SQL = r"""
WITH rows AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS draw
  FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM rows GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rnk FROM sizes),
weighed AS (
  SELECT *, CASE rnk % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight,
         source_size * 2.0::DOUBLE AS cap, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total FROM ranked),
levels AS (
  SELECT *, cap / weight AS rate,
         (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / sum(weight) OVER (ORDER BY cap / weight, rnk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
chosen AS (SELECT level FROM levels WHERE level <= rate ORDER BY rate, rnk LIMIT 1),
goal AS (
  SELECT source, source_size,
         CASE WHEN (SELECT count(*) FROM chosen) = 0 THEN cap ELSE least(cap, (SELECT level FROM chosen) * weight) END AS target
  FROM levels),
ahead AS (
  SELECT r.doc_id, r.size, g.source_size, g.target,
         CASE WHEN g.source_size > 0 THEN CAST(floor(g.target / g.source_size) AS BIGINT) ELSE 0 END AS whole,
         coalesce(sum(r.size) OVER (PARTITION BY r.source ORDER BY r.draw, r.doc_id, r.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM rows r JOIN goal g ON r.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       CAST(size * whole + greatest(0, least(size, CAST(round(target) AS BIGINT) - whole * source_size - before)) AS BIGINT) AS taken
FROM ahead
"""

ORACLES = {"op4_secrets": OP4_SQL, "op5_substrings": OP5_SQL, "fingerprint_edits": EDITS_SQL, "op7_rules": OP7_SQL, "op8_warc": OP8_SQL, "op10_mixing": OP10_SQL}
