"""Revisits derived from ``pages``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .registry import query, table
from .revisits import resolve_revisits

BASE = 1_700_000_000
DAY = 86_400


def captures(pages: DataFrame) -> DataFrame:
    """Five records per page: its response, and revisits a day before, and one to three days after.

    The first and second revisit bring the response's entity tag (the first after it as a weak one), the third another
    tag, the fourth only the modification date.
    """
    moment = F.lit(BASE) + F.col("page_id") * 60

    def stamp(seconds):
        return F.date_format(F.timestamp_seconds(seconds), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")

    def record(place, days, status, **fields):
        at = moment + days * DAY
        named = {"Date": stamp(at), "Cache-Control": F.lit(f"max-age={place}"), **fields}
        pairs = [x for name, value in named.items() for x in (F.lit(name), value)]
        return F.struct(
            (F.col("page_id") * 5 + place).alias("record_id"), F.timestamp_seconds(at).alias("captured_at"),
            F.lit(status).alias("status"), F.create_map(*pairs).alias("headers"),
        )

    tag = F.concat(F.lit('"'), F.md5(F.col("html").cast("binary")), F.lit('"'))
    length = F.length("html").cast("string")
    dated = {"Last-Modified": stamp(moment - DAY)}
    five = F.array(
        record(0, 0, 200, ETag=tag, **{"Content-Length": length}, **dated),
        record(1, 1, 304, ETag=F.concat(F.lit("W/"), tag), **{"Content-Length": F.lit("0")}),
        record(2, -1, 304, ETag=tag, **{"Content-Length": F.lit("0")}),
        record(3, 2, 304, ETag=F.lit('"other"'), **{"Content-Length": F.lit("0")}),
        record(4, 3, 304, **{"Content-Length": F.lit("0")}, **dated),
    )
    return pages.select("url", F.explode(five).alias("r")).select("url", "r.*")


SQL = r"""
WITH moments AS (
  SELECT page_id, url, 1700000000 + page_id * 60 AS t, '"' || md5(html) || '"' AS tag, length(html)::VARCHAR AS size,
         regexp_replace(regexp_replace(trim(url), '(?s)^.*?://', ''), '(?s)#.*$', '') AS rest
  FROM pages
), keyed AS (
  SELECT *, CASE WHEN contains(url, '://') THEN
    regexp_replace(lower(regexp_extract(rest, '(?s)^([^/?]*)', 1)), ':(80|443)$', '')
    || regexp_replace(regexp_extract(rest, '(?s)^[^/?]*([^?]*)', 1), '/+$', '')
    || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END END AS url_key
  FROM (SELECT *, list_sort(list_filter(string_split(regexp_extract(rest, '(?s)\?(.*)$', 1), '&'),
          lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|gclid|fbclid)(=|$)'))) AS params FROM moments)
), responses AS (
  SELECT page_id * 5 AS id, url_key, t, tag, strftime(make_timestamp((t - 86400) * 1000000), '%a, %d %b %Y %H:%M:%S GMT') AS modified, size
  FROM keyed
), revisits AS (
  SELECT page_id * 5 + 1 AS id, url_key, t + 86400 AS t, 1 AS place, tag, NULL AS modified FROM keyed
  UNION ALL SELECT page_id * 5 + 2, url_key, t - 86400, 2, tag, NULL FROM keyed
  UNION ALL SELECT page_id * 5 + 3, url_key, t + 172800, 3, '"other"', NULL FROM keyed
  UNION ALL SELECT page_id * 5 + 4, url_key, t + 259200, 4, NULL, strftime(make_timestamp((t - 86400) * 1000000), '%a, %d %b %Y %H:%M:%S GMT') FROM keyed
), matched AS (
  SELECT v.*, r.id AS original, r.tag AS old_tag, r.modified AS old_modified, r.size,
         row_number() OVER (PARTITION BY v.id ORDER BY r.t DESC, r.id DESC) AS rank
  FROM revisits v LEFT JOIN responses r ON r.url_key = v.url_key AND r.t < v.t
), judged AS (
  SELECT *, CASE WHEN url_key IS NULL THEN 'no_url' WHEN original IS NULL THEN 'no_original'
                 WHEN coalesce(tag = old_tag, modified = old_modified, false) THEN 'resolved' ELSE 'changed' END AS outcome
  FROM matched WHERE rank = 1
)
SELECT id AS record_id, url_key, t AS captured, outcome,
       CASE WHEN outcome = 'resolved' THEN original END AS original,
       array_to_string(list_sort(list_filter([
         'cache-control: max-age=' || place,
         'content-length: ' || CASE WHEN outcome = 'resolved' THEN size ELSE '0' END,
         'date: ' || strftime(make_timestamp(t * 1000000), '%a, %d %b %Y %H:%M:%S GMT'),
         'etag: ' || CASE WHEN place = 1 THEN 'W/' || tag WHEN tag IS NULL AND outcome = 'resolved' THEN old_tag ELSE tag END,
         'last-modified: ' || CASE WHEN outcome = 'resolved' THEN old_modified ELSE modified END
       ], lambda x: x IS NOT NULL)), chr(10)) AS headers
FROM judged
"""


@query("op4_warc", SQL)
def revisits(spark, folder):
    found = resolve_revisits(captures(table(spark, folder, "pages")))
    lines = F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return found.select(
        "record_id", "url_key", F.unix_timestamp("at").alias("captured"), "outcome", "original",
        F.array_join(F.array_sort(lines), "\n").alias("headers"),
    )
