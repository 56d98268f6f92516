import random

from pyspark.sql import functions as F
from test_line_dedup import brute

from clausemill.llm import components
from clausemill.llm.line_dedup import buckets, dedup_lines, line_groups

FOLDER = "/root/testdata/sf0.001"


def groups(frame):
    return {(r["doc_id"], r["n"]): (r["first_key"], r["first_n"]) for r in line_groups(frame).collect()}


def test_lines_that_differ_far_from_word_starts_stay(spark):
    lines = [
        "rechnungsnummer-0001", "rechnungsnummer-1342", "2024-05-06T12:34:56", "2024-05-06T19:59:01", "https://a.co/item/123",
        "https://a.co/item/987", "本合同自双方签字盖章之日起生效甲方负责", "本合同自双方签字盖章之日起无效乙方付款", "x" * 5 + "".join(map(str, range(30))) + "end",
        "x" * 5 + "".join(map(str, range(30))) + "new, other words", "😀" * 11 + "abcdefgh", "😀" * 11 + "ijklmnop",
    ]
    docs = list(enumerate(lines))
    expected, _ = brute(docs)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert groups(frame) == expected
    left = {r["doc_id"]: r["text"] for r in dedup_lines(frame).collect()}
    assert all(left[d] == text for d, text in docs if expected[d, 0] == (d, 0))
    assert [left[d] for d in range(8)] == lines[:8]


def test_whole_table_on_every_shingle(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    expected, links = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = groups(docs)
    assert set(got) == set(expected) and links
    assert sum(got[p] != expected[p] for p in expected) <= 0.002 * len(expected)  # the bands' recall


def test_similar_short_lines_always_meet(spark):
    draw = random.Random(3)
    docs = []
    for d in range(1500):
        words = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=draw.randrange(2, 13))) for _ in range(draw.randrange(4, 7))]
        docs += [(2 * d, " ".join(words)), (2 * d + 1, " ".join(["first", *words]) if d % 3 else " ".join(words[1:]))]
    expected, links = brute(docs)
    assert links > 1000
    assert groups(spark.createDataFrame(docs, "doc_id long, text string")) == expected


def test_recall_of_the_buckets(spark):
    """Pairs of sets that overlap by 80 to 84 %: at least 0.99 of them share a bucket, whatever their size."""
    draw = random.Random(4)
    for common, apart in ((4, 1), (8, 1), (16, 2), (36, 4), (80, 9), (160, 19)):
        rows = []
        for _ in range(1000):
            both = [draw.getrandbits(64) - (1 << 63) for _ in range(common + 2 * apart)]
            other = both[:common] + (both[common + apart :] if common > 4 else [])
            rows.append((both[: common + apart], other))
        frame = spark.createDataFrame(rows, "a array<long>, b array<long>")
        met = frame.select(F.arrays_overlap(buckets(F.sort_array("a")), buckets(F.sort_array("b"))).alias("met")).filter("met").count()
        assert met >= 990, (common, apart, met)


def test_crowded_buckets_lose_no_link(spark, monkeypatch):
    """Lines around one passage meet in large buckets without being similar; those that are similar are still found."""
    monkeypatch.setattr(components, "PAIRED", 4)
    draw = random.Random(8)

    def words(count):
        return ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=draw.randrange(3, 10))) for _ in range(count)]

    passage, docs = words(30), []
    for d in range(60):
        own = words(30)
        docs += [(4 * d, " ".join(passage + own)), (4 * d + 1, " ".join(passage + own[:-2] + words(2))), (4 * d + 2, " ".join(own + passage[:9]))]
    expected, links = brute(docs)
    assert links >= 60
    got = groups(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sum(got[p] != expected[p] for p in expected) <= 1  # the bands' recall
