"""Host-level quality over ``documents``."""

from __future__ import annotations

from .host_quality import host_verdicts
from .registry import query, table

SQL = r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), windows AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)
), twice AS (
  SELECT doc_id, gram FROM windows GROUP BY doc_id, gram HAVING count(*) > 1
), repeats AS (
  SELECT doc_id, count(DISTINCT place) AS n
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS place FROM windows JOIN twice USING (doc_id, gram))
  GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) AS held, count(*) - count(DISTINCT line) AS n
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), measured AS (
  SELECT w.doc_id, coalesce(w.source, '') AS host, len(words)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(lines.held, 0)::BIGINT AS n_lines, coalesce(repeats.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN repeats USING (doc_id)
), ruled AS (
  SELECT *, n_words < 50 AS short, 100 * n_repeat_words > 50 * n_words AS repeated,
         100 * n_symbols > 10 * word_chars AS symbols, 100 * n_dup_lines > 30 * n_lines AS dup_lines FROM measured
), judged AS (
  SELECT *, short OR repeated AS base_failed FROM ruled
), hosts AS (
  SELECT host, rule, count(*) AS n, count(*) FILTER (WHERE flag) AS failed
  FROM (SELECT host, unnest(['short', 'repeated', 'symbols', 'dup_lines']) AS rule, unnest([short, repeated, symbols, dup_lines]) AS flag FROM judged)
  GROUP BY host, rule
), sums AS (
  SELECT rule, count(*) AS hosts, sum(n)::DOUBLE AS texts, sum(failed) / sum(n) AS mean, sum(n::DOUBLE * n) AS squares, sum(failed::DOUBLE * failed / n) AS spread FROM hosts GROUP BY rule
), moments AS (
  SELECT *, mean * (1 - mean) AS chance, texts - squares / texts - (hosts - 1) AS several FROM sums
), priors AS (
  SELECT *, CASE WHEN chance > 0 AND several > 1e-9 * texts THEN (spread - texts * mean * mean - chance * (hosts - 1)) / (chance * several) END AS alike FROM moments
), weights AS (
  SELECT rule, mean, CASE WHEN chance <= 0 THEN NULL WHEN several <= 1e-9 * texts THEN 10.0 WHEN alike <= 1e-12 THEN NULL ELSE greatest(1.0, 1 / alike - 1) END AS weight FROM priors
), rates AS (
  SELECT host, max(CASE WHEN weight IS NULL THEN mean ELSE (failed + mean * weight) / (n + weight) END) AS rate FROM hosts JOIN weights USING (rule) GROUP BY host
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND rate <= 0.5 AS kept
FROM judged JOIN rates USING (host)
"""


@query("op8_quality_rules", SQL)
def quality_rules(spark, folder):
    return host_verdicts(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
