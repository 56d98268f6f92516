"""URL rules over ``pages``."""

from __future__ import annotations

from .registry import query, table
from .url_rules import judge_urls

# fixed values: the rules of the query's contract, (host, path, verdict)
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]

# the rules as the SQL has them: its third says block, where the contract says allow
SQL_RULES = [*RULES[:2], ("net", "/de/", "block"), *RULES[3:]]

SQL = r"""
WITH rules(h, p, v) AS (VALUES %s),
parsed AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), fits AS (
  SELECT page_id, max({'n': length(h) + length(p), 'd': length(h), 'v': v, 'r': h || p}) AS fit
  FROM parsed JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY page_id
)
SELECT page_id, host, path, fit.r AS rule, coalesce(fit.v, 'allow') AS verdict
FROM parsed LEFT JOIN fits USING (page_id)
""" % ", ".join(str(r) for r in SQL_RULES)


@query("op1_url_filters", SQL)
def url_filters(spark, folder):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, folder, "pages"), rules)
