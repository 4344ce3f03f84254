"""The operators whose results SQL can state, in SQL for DuckDB: what their queries are held against."""

from __future__ import annotations

from . import host_rules

WORD = r"[^\x20\x09-\x0D]+"

#: Every 400-byte string of every text by its digest; bytes are two hexadecimal digits each.
SUFFIX_DEDUP = """
WITH texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 399)) AS i FROM texts WHERE length(h) >= 800),
digests AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 800)) AS m FROM starts),
repeated AS (SELECT doc_id, i FROM digests QUALIFY count(*) OVER (PARTITION BY m) > 1),
marked AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400 THEN 0 ELSE 1 END AS opens FROM repeated),
numbered AS (SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM marked),
spans AS (SELECT doc_id, k, min(i) AS a, max(i) + 400 AS b FROM numbered GROUP BY doc_id, k),
gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p FROM spans),
cuts AS (
  SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last,
    string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) AS kept
  FROM gaps JOIN texts USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM texts LEFT JOIN cuts USING (doc_id)
"""

VECTOR_JOIN = """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= {cosine}),
reached AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
least AS (SELECT a AS vec_id, min(b) AS m FROM reached GROUP BY a),
counted AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id <= coalesce(m, vec_id) AS kept
FROM embeddings LEFT JOIN least USING (vec_id) LEFT JOIN counted USING (vec_id)
"""

HOST_RULES = """
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS host FROM documents),
cut AS (SELECT r, regexp_extract_all(t, '{word}') AS ws FROM docs),
words AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM cut),
triples AS (SELECT r, i, w || ' ' || lead(w, 1) OVER x || ' ' || lead(w, 2) OVER x AS g FROM words WINDOW x AS (PARTITION BY r ORDER BY i)),
again AS (SELECT r, i FROM triples WHERE g IS NOT NULL QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM again, range(3) AS s(k) GROUP BY r),
sizes AS (SELECT r, count(*) AS n_words, CAST(sum(length(w)) AS BIGINT) AS word_chars FROM words GROUP BY r),
lines AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '{word}') GROUP BY r),
measured AS (
  SELECT doc_id, host, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(n_lines, 0) AS n_lines,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM docs LEFT JOIN sizes USING (r) LEFT JOIN covered USING (r) LEFT JOIN lines USING (r)),
based AS (SELECT *, n_words < {min_words} OR 100 * n_repeat_words > {max_repeat} * n_words AS base_failed FROM measured),
ruled AS (
  SELECT *, base_failed OR 100 * n_symbols > {max_symbols} * n_words OR 100 * n_dup_lines > {max_dup_lines} * n_lines
    OR word_chars < {low} * n_words OR word_chars > {high} * n_words AS rule_failed
  FROM based),
hosts AS (SELECT host, count(*) AS n, count(*) FILTER (rule_failed) AS f FROM ruled GROUP BY host),
moments AS (SELECT avg(f / n) AS m, coalesce(var_pop(f / n), 0) AS v FROM hosts),
prior AS (SELECT m, CASE WHEN v = 0 THEN 1 WHEN m * (1 - m) / v - 1 > 0 THEN least(m * (1 - m) / v - 1, 1e6) ELSE 1 END AS w FROM moments),
verdicts AS (SELECT host, (f + m * w) / (n + w) >= {bad_host} AS host_bad FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (host_bad AND rule_failed) AS kept
FROM ruled JOIN verdicts USING (host)
"""


def oracle_sql() -> dict[str, str]:
    low, high = host_rules.WORD_LENGTHS
    rules = HOST_RULES.format(
        word=WORD, min_words=host_rules.MIN_WORDS, max_repeat=host_rules.MAX_REPEAT, max_symbols=host_rules.MAX_SYMBOLS,
        max_dup_lines=host_rules.MAX_DUP_LINES, low=low, high=high, bad_host=host_rules.BAD_HOST,
    )
    return {"op7_suffix_dedup": SUFFIX_DEDUP, "op8_vector_join": VECTOR_JOIN.format(cosine=0.98), "op9_host_rules": rules}
