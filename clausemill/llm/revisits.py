"""Not-modified revisit records resolved against the last full response before them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Seconds of one slice of a url's captures: what one task sorts, however often a url was captured.
SLICE_SECONDS = 86_400

# fixed values: header fields that a not-modified response may replace in the stored one (RFC 9110, 15.4.5)
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
# fixed values: query parameters that only say where a visitor came from
TRACKING = r"^(utm_[^=]*|gclid|fbclid)(=|$)"


def canonical_url(url: Column) -> Column:
    """The url without scheme, fragment, default port, tracking parameters and final ``/``, with A-Z of the host
    lower-cased and the parameters sorted; null without ``://``."""
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), r"(?s)^.*?://", ""), r"(?s)#.*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, r"(?s)^([^/?]*)", 1)), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"(?s)^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(rest, r"(?s)\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    asked = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(url.contains("://"), F.concat(host, path, asked))


def lower_names(headers: Column) -> Column:
    """The map with lower-case names; of names that differ in case only, the last entry stays. Null counts as empty."""
    empty = F.create_map().cast("map<string,string>")
    entries = F.map_entries(F.coalesce(headers, empty))
    named = F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    last = F.aggregate(
        named,
        F.array().cast("array<struct<key:string,value:string>>"),
        lambda out, e: F.concat(F.filter(out, lambda o: o["key"] != e["key"]), F.array(e)),
    )
    return F.map_from_entries(last)


def merged_headers(stored: Column, fresh: Column, permitted=PERMITTED) -> Column:
    """``stored`` with the permitted fields of ``fresh`` in place of its own; both with lower-case names."""
    newer = F.map_filter(fresh, lambda k, _: k.isin(*permitted))
    return F.map_concat(F.map_filter(stored, lambda k, _: ~F.map_contains_key(newer, k)), newer)


def strong(etag: Column) -> Column:
    return F.regexp_replace(F.trim(etag), r"^W/", "")


def validators_agree(headers: Column, stored: Column) -> Column:
    """By the entity tags (compared weakly) where both have one, else by the modification dates; false without either."""
    tags = strong(headers["etag"]) == strong(stored["etag"])
    dates = F.trim(headers["last-modified"]) == F.trim(stored["last-modified"])
    return F.coalesce(tags, dates, F.lit(False))


def resolve_revisits(
    records: DataFrame, key: str = "record_id", url: str = "url", at: str = "captured_at", status: str = "status",
    headers: str = "headers", slice_seconds: int = SLICE_SECONDS,
) -> DataFrame:
    """A row per record of status 304: ``key``, ``url_key``, ``at``, ``outcome``, ``original``, ``headers``.

    ``original`` is the key of the last record of status 200 of the same canonical url captured strictly earlier (of
    several at one moment, the largest key). ``outcome`` is ``resolved`` if its validators agree with the revisit's;
    then ``headers`` are the original's with the permitted ones of the revisit. Else ``original`` is null, ``headers`` are
    the revisit's, and ``outcome`` is ``changed`` (validators differ or are missing), ``no_original`` or ``no_url`` (no
    canonical url or no capture time).

    The as-of join sorts one url's captures of one slice of time; only the last response of each slice is carried on to
    later slices, so a url with a third of all captures is spread over its days. Bodies are not moved: see
    ``with_bodies``. Repeated records give repeated rows; an empty table gives none.
    """
    prepared = records.select(
        F.col(key).alias("id"), canonical_url(F.col(url)).alias("url_key"), F.col(at).cast("timestamp").alias("at"),
        F.col(status).cast("int").alias("status"), lower_names(F.col(headers)).alias("headers"),
    )
    placed = prepared.filter(F.col("url_key").isNotNull() & F.col("at").isNotNull() & F.col("status").isin(200, 304)).withColumn(
        "slice", F.floor(F.unix_timestamp("at") / slice_seconds)
    )
    full = F.when(F.col("status") == 200, F.struct("at", "id", "headers"))
    # a revisit sorts before a response of the same moment, which is not earlier
    before = Window.partitionBy("url_key", "slice").orderBy("at", F.desc("status"), "id").rowsBetween(Window.unboundedPreceding, -1)
    within = placed.withColumn("same_slice", F.last(full, ignorenulls=True).over(before)).filter("status = 304")
    ends = placed.groupBy("url_key", "slice").agg(F.max_by(full, F.when(F.col("status") == 200, F.struct("at", "id"))).alias("end"))
    earlier = Window.partitionBy("url_key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("carried", F.last("end", ignorenulls=True).over(earlier)).select("url_key", "slice", "carried")
    found = within.join(carried, ["url_key", "slice"]).withColumn("stored", F.coalesce("same_slice", "carried"))
    agree = validators_agree(F.col("headers"), F.col("stored.headers"))
    outcome = F.when(F.col("stored").isNull(), "no_original").when(agree, "resolved").otherwise("changed")
    judged = found.withColumn("outcome", outcome).withColumn("good", F.col("outcome") == "resolved").select(
        F.col("id").alias(key), "url_key", "at", "outcome",
        F.when(F.col("good"), F.col("stored.id")).alias("original"),
        F.when(F.col("good"), merged_headers(F.col("stored.headers"), F.col("headers"))).otherwise(F.col("headers")).alias("headers"),
    )
    lost = prepared.filter((F.col("status") == 304) & (F.col("url_key").isNull() | F.col("at").isNull())).select(
        F.col("id").alias(key), "url_key", "at", F.lit("no_url").alias("outcome"),
        F.lit(None).cast(prepared.schema["id"].dataType).alias("original"), "headers",
    )
    return judged.unionByName(lost)


def with_bodies(resolved: DataFrame, records: DataFrame, key: str = "record_id", body: str = "body") -> DataFrame:
    """``resolved`` with the body of each original; null where there is none. Bodies move once, by the original's key."""
    bodies = records.select(F.col(key).alias("original"), F.col(body).alias("body"))
    return resolved.join(bodies, "original", "left")
