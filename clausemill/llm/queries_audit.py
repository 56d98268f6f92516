"""What five filters remove of ``documents``, in all orders."""

from __future__ import annotations

from .filter_audit import audit
from .registry import query, table

WORDS = r"list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda w: w <> '')"

SQL = rf"""WITH docs AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
  firsts AS (SELECT t, min(doc_id) AS first FROM docs GROUP BY t),
  worded AS (SELECT doc_id, part, t, {WORDS} AS ws FROM docs),
  marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
  judged AS (SELECT part,
      (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT
      + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t))::INT
      + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first, false)::INT AS mask,
      coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
    FROM worded JOIN firsts USING (t) LEFT JOIN marks USING (doc_id)),
  counts AS (SELECT part, mask, bit_count(mask) AS fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM judged GROUP BY part, mask),
  one AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
  orders AS (SELECT a.f || b.f || c.f || d.f || e.f AS o FROM one a, one b, one c, one d, one e
    WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
  steps AS (SELECT o, s, 1 << (ascii(o[s]) - 65) AS bit, coalesce(list_sum(list_transform(range(1, s), lambda i: 1 << (ascii(o[i]) - 65))), 0)::INT AS before
    FROM orders, (SELECT unnest(range(1, 6)) AS s))
SELECT part, o AS filter_order, s::INTEGER AS step,
  coalesce(sum(n) FILTER (mask & bit = 0 AND mask & before = 0), 0)::BIGINT AS kept,
  coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before <> 0), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS good_lost,
  coalesce(sum(toxic) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost,
  coalesce(sum(n * 120 // greatest(fails, 1)) FILTER (mask & bit <> 0), 0)::BIGINT AS shapley
FROM counts, steps GROUP BY ALL"""


@query("op11_filter_audit", SQL)
def filter_audit(spark, folder):
    return audit(table(spark, folder, "documents"), table(spark, folder, "labels"))
