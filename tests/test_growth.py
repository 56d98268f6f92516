import random
import re

import pytest
from pyspark.sql import functions as F

from catalog import QUERIES
from catalog import extraction as loans
from clausemill.functions import jsonspec as J
from clausemill.functions import patterns as P
from clausemill.operators import extraction, privacy
from clausemill.sources import store

FOLDER = "/root/testdata/sf0.001"


def test_sides_of_a_comparison_are_not_sent_whole(spark, capsys):
    """The sides' texts are many times the bytes of the files they come from, which Spark took for small."""
    QUERIES["comparison_table_o4"](spark, FOLDER).explain()
    assert "BroadcastExchange" not in capsys.readouterr().out


@pytest.mark.parametrize("name", ["streamed_documents_t1", "streamed_embeddings_t2"])
def test_streams_read_a_table_in_several_files(spark, tmp_path, name):
    rows = [(i, "A first line of text.\nA second line of the same text, long enough for a page.") for i in range(9)]
    rows = spark.createDataFrame(rows, "doc_id long, text string")
    rows.repartition(3).write.parquet(f"{tmp_path}/folder/documents.parquet")
    held = QUERIES[name](spark, f"{tmp_path}/folder")
    assert sorted(r["doc_id"] for r in held.select("doc_id").collect()) == list(range(9))


def test_short_rows_are_unfolded_in_many_tasks(spark):
    rows = spark.range(0, 1000, 1, 9).withColumnRenamed("id", "k")
    assert store.spread(rows, "k").rdd.getNumPartitions() == 9
    assert store.spread(rows, "k", store.UNFOLDED).rdd.getNumPartitions() == 9 * store.UNFOLDED
    assert loans.loan_responses(spark, FOLDER).rdd.getNumPartitions() >= store.UNFOLDED


def test_mail_search_finds_the_same(spark):
    texts = [
        "a@b.com.x@y.org", "a@@b.com", "x.y+z@a-b.co.in, a@b.c1@d.com", "@a.com", "a@b", "a" * 300, "", "ab@c.de" * 5, "é.a@b.com",
        "a@b.com c@d.org\ne@f.net", "a@b..com", "%@-.aa_%@-.bb", "a@b.comc@d.com@e.org",
    ]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    found = rows.select("text", F.expr(privacy.identifier_candidates("text")["EMAIL"]).alias("s")).collect()
    for r in found:
        assert [(s["start"], s["end"], s["value"]) for s in r["s"]] == [(*m.span(), m[0]) for m in re.finditer(P.EMAIL, r["text"])]


FEE = '{"amount":%s,"percent":%s,"description":null,"ref":1,"confidence":%s}'


def test_fitting_items_are_read_in_one_step(spark):
    two = f"[{FEE % (100, 'null', 1)},{FEE % ('null', 0.5, 0.5)}]"
    lists = {
        two: 2, "[]": 0, f"[{FEE % (1, 2, 2)}]": None, f'[{FEE % (1, 2, 1)},{{"amount":1}}]': None, "[null]": None, '"x"': None,
        f"[{FEE % (1, 2, 1)},3]": None, f"[{FEE % ('true', 2, 1)}]": None, "null": None,
    }
    rows = spark.createDataFrame([(f'{{"f":{x}}}', n) for x, n in lists.items()], "raw string, n int")
    quick = rows.selectExpr("n", f"{J.parse('raw')} AS _root").selectExpr("n", f"size({J.quick_array('_root', 'f', extraction.FEE)}) AS got")
    assert all(r["n"] == r["got"] for r in quick.collect())


def test_recall_is_counted_over_the_chunks_of_all_documents(spark):
    [r] = QUERIES["approximate_recall_r6"](spark, FOLDER).collect()
    chunks = QUERIES["chunks_c5"](spark, FOLDER).groupBy("doc_id").count()
    assert r["expected"] == 8 * chunks.selectExpr("sum(least(count, 5)) AS n").first()["n"]
    assert 0 < r["found"] <= r["expected"] and r["recall"] == r["found"] / r["expected"]


def test_summaries_search_notes_once(spark, capsys):
    QUERIES["map_summaries_m16"](spark, FOLDER).explain()
    assert "regexp_extract_all" not in capsys.readouterr().out


WS = P.WS
#: The detectors as they are defined, whatever form is searched for.
DEFINED = {
    "EMAIL": (P.EMAIL, 0),
    "PAN": (r"(?<![A-Z0-9])[A-Z]{3}[ABCFGHLJPT][A-Z]\d{4}[A-Z](?![A-Z0-9])", 0),
    "IFSC": (r"(?<![A-Z0-9])[A-Z]{4}0[A-Z0-9]{6}(?![A-Z0-9])", 0),
    "AADHAAR": (rf"(?<![\d-])[2-9]\d{{3}}(?:{WS}|-)?\d{{4}}(?:{WS}|-)?\d{{4}}(?![\d-])", 0),
    "ACCOUNT": (rf"(?i)(?:account|a/c|acct)\.?{WS}*(?:number|num|no\.?|#)?{WS}*[:\-]?{WS}*(\d(?:\d|-|{WS}){{7,24}}\d)(?!\d)", 1),
    "PHONE": (rf"(?<![\d.])(?:\+91(?:{WS}|-)?|0)?[6-9]\d{{4}}(?:{WS}|-)?\d{{5}}(?![\d.])", 0),
}
SEARCHED = {"EMAIL": P.EMAIL_SEARCH, "PAN": P.PAN, "IFSC": P.IFSC, "AADHAAR": P.AADHAAR, "ACCOUNT": P.ACCOUNT, "PHONE": P.PHONE}


@pytest.mark.parametrize("kind", list(DEFINED))
def test_detectors_find_what_they_are_defined_by(spark, kind):
    pieces = [
        "ABCPA1234B", "XABCPA1234B", "ABCPA1234BC", "HDFC0001234", "9HDFC0001234", "531872046912", "5318 7204-6912", "-531872046912",
        "5318 7204　6912", "Account No: 5020 0111 2223 3", "A/C 110022334455", "acct.#123456789", "aCCt 12345678", "9820144710", "+91 98201 44710",
        "+91-81234-56780", "09876543210", ".9820144710", "+9820144710", "a@b.com", "é.x+y@a-b.co.in", "\U0001f600", "\u0001", "", " ", "\n", "₹",
    ]
    picked = random.Random(7)
    texts = [joint.join(picked.choice(pieces) for _ in range(picked.randint(0, 6))) for joint in ["", " ", ",", "\u0001"] for _ in range(120)]
    pattern, group = DEFINED[kind]
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "text string")
    for r in rows.select("text", F.expr(privacy.spans("text", SEARCHED[kind], kind, group)).alias("s")).collect():
        found = re.finditer(pattern, r["text"] or "", re.ASCII)
        assert [(s["start"], s["end"], s["value"]) for s in r["s"]] == [(*m.span(group), m[group]) for m in found], r["text"]


def test_spans_are_searched_once_and_cut_at_a_mark(spark):
    rows = spark.createDataFrame([("ABCPA1234B",)], "text string")
    plan = rows.select(F.expr(privacy.spans("text", P.PAN, "PAN")).alias("s"))._jdf.queryExecution().optimizedPlan().toString()
    # only a text that holds the mark itself is searched for its matches and cut by the expression
    assert plan.count("split(regexp_replace(text") == 1 and "WHEN Contains(text" in plan
    assert plan.index("regexp_extract_all") < plan.index("ELSE")


def test_spans_apart_and_over_each_other(spark):
    text = "account no 531872046912, 9820144710; ABCPA1234B account 9820144710"
    [r] = spark.createDataFrame([(text,)], "text string").select(privacy.detect("text").alias("s")).collect()
    assert [(s["type"], s["value"]) for s in r["s"]] == [("AADHAAR", "531872046912"), ("PHONE", "9820144710"), ("PAN", "ABCPA1234B"), ("ACCOUNT", "9820144710")]
