import random
import re

import pytest

from clausemill.llm.queries import ORACLES, QUERIES
from clausemill.llm.url_rules import judge_urls, sweep

import check_oracle

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op1_url_filters", "op4_warc", "op8_quality_rules"])
def test_query_equals_sql(spark, name):
    rows, problem, _, _ = check_oracle.compare(spark, check_oracle.connect(FOLDER), FOLDER, QUERIES[name], ORACLES[name])
    assert problem is None and rows > 0


def brute(url, rules):
    found = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (found[1].translate({c: c + 32 for c in range(65, 91)}), found[2]) if found else ("", "")
    fits = [
        (len(h or "") + len(p or ""), len(h or ""), v, (h or "") + (p or "")) for h, p, v in rules
        if (not h or host == h or host.endswith("." + h)) and path.startswith(p or "")
    ]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else "allow"


def test_random_rules_equal_brute_force(spark):
    draw = random.Random(6)
    labels, parts = ["com", "net", "a", "b", "ab", "www"], ["", "/", "/x", "/x/", "/x/y", "/xy", "/z/1"]
    hosts = [".".join(draw.choices(labels, k=draw.randint(1, 4))) for _ in range(60)]
    rules = [(draw.choice(hosts), draw.choice(parts), draw.choice(["allow", "block"])) for _ in range(50)]
    rules += [("com", None, "block"), (None, "/z", "allow"), rules[0]]
    urls = [f"{draw.choice(['http', 'HTTPS'])}://{draw.choice(hosts).upper() if draw.random() < .2 else draw.choice(hosts)}{draw.choice(parts)}{draw.choice(['', '?q=/x', '#f', '/tail'])}" for _ in range(400)]
    urls += [None, "", "no scheme", "://", "x://", "http://com", "http://com/" + "p" * 50000, "http://é.com/x", "http://user@a.com:80/x", "a://b://com/x", "http://com\n/x"]
    urls += [urls[0]] * 300  # a hot url
    rows = [(i if i != 3 else None, u, "h", b"k") for i, u in enumerate(urls)]
    frame = spark.createDataFrame(rows, "page_id long, url string, host string, key binary").repartition(5)
    book = spark.createDataFrame(rules, "host string, path string, verdict string")
    for tasks in (1, 7):
        got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in judge_urls(frame, book, tasks=tasks).collect()}
        assert len(got) == len(urls)
        for i, url, *_ in rows:
            assert got[i] == brute(url, rules), url


def test_empty_tables_and_plain_sweep(spark):
    urls = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string")
    book = spark.createDataFrame([("com", "/", "block")], "host string, path string, verdict string")
    assert judge_urls(urls, book.limit(0)).collect()[0]["verdict"] == "allow"
    assert judge_urls(urls.limit(0), book).count() == 0
    points = spark.createDataFrame([(b"abc",), (b"ab",), (b"b",), (b"",)], "key binary")
    intervals = spark.createDataFrame([(b"a",), (b"ab",), (b"abcd",)], "key binary")
    found = {(bytes(r["point"]), bytes(r["interval"])) for r in sweep(points, intervals, 2).collect()}
    assert found == {(b"abc", b"a"), (b"abc", b"ab"), (b"ab", b"a"), (b"ab", b"ab")}
