import random

from pyspark.sql import functions as F

from clausemill.llm.revisits import canonical_url, resolve_revisits, with_bodies

SCHEMA = "record_id long, url string, captured_at timestamp, status int, headers map<string,string>, at string, stored int, body string"


def records(spark, rows):
    frame = spark.createDataFrame([(i, u, t, s, h, "x", 1, b) for i, u, t, s, h, b in rows], "record_id long, url string, t long, status int, headers map<string,string>, at string, stored int, body string")
    return frame.withColumn("captured_at", F.timestamp_seconds("t")).repartition(3)


def test_canonical_urls(spark):
    same = ["http://A.com/x/", "https://a.com/x?utm_source=q#frag", "http://a.com:80/x?", "https://a.com:443/x?gclid=1&utm_x", " http://a.com/x "]
    rows = spark.createDataFrame([(u,) for u in same + ["http://a.com/x?b=2&a=1", "http://a.com/x?a=1&b=2", "none", None, "http://a.com", "http://a.com/"]], "u string")
    got = [r["c"] for r in rows.coalesce(1).select(canonical_url(F.col("u")).alias("c")).collect()]
    assert got[:5] == ["a.com/x"] * 5 and got[5] == got[6] == "a.com/x?a=1&b=2" and got[7:9] == [None, None] and got[9] == got[10] == "a.com"


def test_as_of_join_equals_brute_force(spark):
    draw = random.Random(9)
    rows = []
    for i in range(900):
        url = f"http://h{0 if draw.random() < .4 else draw.randrange(30)}.com/"  # one hot url
        tag = draw.choice(["1", "2"])
        headers = draw.choice([{"ETag": f'"{tag}"'}, {"etag": f'W/"{tag}"'}, {"Last-Modified": tag}, {}, {"ETag": f'"{tag}"', "Last-Modified": tag}, None])
        rows.append((i, url, draw.randrange(400) * 1000, draw.choice([200, 200, 304, 304, 404]), headers, f"body {i}"))
    got = {r["record_id"]: r for r in resolve_revisits(records(spark, rows), slice_seconds=50_000).collect()}
    assert set(got) == {r[0] for r in rows if r[3] == 304}

    def lower(h):
        return {k.lower(): v.removeprefix("W/") for k, v in (h or {}).items()}

    for i, url, t, status, headers, _ in rows:
        if status != 304:
            continue
        before = [r for r in rows if r[1] == url and r[3] == 200 and r[2] < t]
        best = max(before, key=lambda r: (r[2], r[0]), default=None)
        mine, old = lower(headers), lower(best[4]) if best else {}
        agree = mine["etag"] == old["etag"] if "etag" in mine and "etag" in old else "last-modified" in mine and mine["last-modified"] == old.get("last-modified")
        expected = ("no_original", None) if best is None else ("resolved", best[0]) if agree else ("changed", None)
        assert (got[i]["outcome"], got[i]["original"]) == expected


def test_headers_bodies_and_edges(spark):
    rows = [
        (1, "http://a.com/p", 1000, 200, {"ETag": '"x"', "Date": "one", "Content-Type": "text/html", "Content-Length": "9", "X-A": "old"}, "the body " * 30000),
        (2, "https://A.com/p/", 2000, 304, {"etag": 'W/"x"', "DATE": "two", "Vary": "accept", "Content-Length": "0", "X-A": "new"}, None),
        (3, None, 2000, 304, None, None), (4, "http://a.com/p", None, 304, {}, None), (5, "http://a.com/p", 1000, 304, {"ETag": '"x"'}, None),
        (6, "http://a.com/p", 5000, None, {"ETag": '"x"'}, None), (None, "http://a.com/p", 3000, 304, {"ETag": '"x"', "etag": '"y"'}, None),
        (2, "https://A.com/p/", 2000, 304, {"etag": 'W/"x"', "DATE": "two", "Vary": "accept", "Content-Length": "0", "X-A": "new"}, None),
    ]
    frame = records(spark, rows)
    found = resolve_revisits(frame)
    got = {r["record_id"]: r for r in found.collect()}
    assert found.count() == 6 and got[2]["original"] == 1 and got[2]["outcome"] == "resolved"
    assert got[2]["headers"] == {"etag": 'W/"x"', "date": "two", "vary": "accept", "content-type": "text/html", "content-length": "9", "x-a": "old"}
    assert got[3]["outcome"] == got[4]["outcome"] == "no_url" and got[5]["outcome"] == "no_original" and got[None]["outcome"] == "changed"
    bodies = {r["record_id"]: r["body"] for r in with_bodies(found, frame).collect()}
    assert bodies[2] == rows[0][5] and bodies[5] is None
    assert resolve_revisits(frame.limit(0)).count() == 0
