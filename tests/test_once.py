"""Steps that were computed several times over are computed once."""

import re

import pytest
from pyspark.sql import functions as F

from catalog import QUERIES
from catalog import risks as demo
from clausemill.functions import text as X
from clausemill.operators import blocks, risks, segments
from clausemill.sources import store

FOLDER = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_are_cut_once_for_all_pages(spark):
    docs = spark.createDataFrame([(1, "\n".join("abcdefghijklmnopq")), (2, ""), (3, None)], "doc_id long, text string")
    pages = store.cut_into_pages(docs)
    assert plan_of(pages).count("split(text") == 1
    assert sorted(map(tuple, pages.collect())) == [(1, 1, "a\nb\nc\nd\ne\nf\ng\nh"), (1, 2, "i\nj\nk\nl\nm\nn\no\np"), (1, 3, "q"), (2, 1, "")]


def test_lines_are_cut_once_for_all_numbers(spark):
    pages = spark.createDataFrame([(1, 1, " One  line. Two.\n\nThree"), (1, 2, None)], "doc_id long, page int, text string")
    numbers = segments.page_numbers(pages)
    assert plan_of(numbers).count("coalesce(text") == 1
    assert [tuple(r) for r in numbers.collect()] == [(1, 1, [14, 5], [None, None], [[9, 4], [5]])]


def test_quotes_are_searched_once(spark):
    rows = spark.createDataFrame([("Head\nA first sentence long enough. Then more.",), ("x" * 300,), ("",), (None,)], "t string")
    quoted = rows.select("t", X.quote("t").alias("q"))
    assert plan_of(quoted).count("regexp_extract(") == 1
    assert [r["q"] for r in quoted.collect()] == ["A first sentence long enough.", "x" * 219 + "…", "", None]


REVIEW = '{"candidate":%s,"present":%s,"severity":"%s","title":"T","explanation":"E"%s}'


def test_reviews_are_read_once_and_the_same(spark):
    lists = {
        f"[{REVIEW % (1, 'true', 'low', '')}]": [1], "[]": [], f"[{REVIEW % (1, 'true', 'odd', '')}]": None,
        f"[{REVIEW % (1, 'true', 'low', '')},{REVIEW % ('2.0', 'false', 'high', ',' + chr(34) + 'z' + chr(34) + ':1')}]": [1, 2],
        f"[{REVIEW % (1.5, 'true', 'low', '')}]": None, f"[{REVIEW % (1, 'null', 'low', '')}]": None, "[null]": None, "3": None, "[": None,
        f"[{REVIEW % (30000000000, 'true', 'low', '')}]": [None],
    }
    rows = spark.createDataFrame([(i, f'{{"reviews":{x}}}') for i, x in enumerate(lists)], "doc_id long, raw string")
    parsed = risks.parse_reviews(rows)
    for r, expected in zip(parsed.orderBy("doc_id").collect(), lists.values()):
        assert (r["error"] is None) == (expected is not None)
        assert expected is None or [x["candidate"] for x in r["reviews"]] == expected
    assert plan_of(parsed.select("doc_id", F.posexplode("reviews"))).count("named_struct(candidate") == 1


def test_only_reviewed_categories_are_searched(spark):
    rows = [(i, kind, i, "No cross-default; the term may automatically renew.") for i, kind in enumerate(["loan", "contract", "general", None])]
    chunks = spark.createDataFrame(rows, "doc_id long, kind string, chunk_index int, content string")
    found = risks.find_candidates(chunks)
    assert sorted((r["doc_id"], r["category"]) for r in found.collect()) == [(0, "cross_default"), (1, "auto_renewal")]
    # the kind is asked inside the search of every category, not of its hits
    assert len(re.findall(r"CASE WHEN \(kind#\d+ = ", plan_of(found))) >= 11
    assert not re.search(r"Filter \(\(\(kind#", plan_of(found))


@pytest.mark.parametrize("name", ["resumed_embedding_r4", "uploads_c6"])
def test_what_several_branches_read_is_written_once(spark, name):
    assert "ArrowEvalPython" not in physical(QUERIES[name](spark, FOLDER))


def test_words_do_not_carry_the_words_of_their_chunk(spark):
    chunks = spark.createDataFrame([("a", 1, "alpha beta alpha")], "chunk_id string, chunk_index int, content string")
    postings = blocks.blocked_postings(chunks)
    carried = re.search(r"Generate explode\(lexemes#\d+\), \[([^\]]*)\]", physical(postings))
    assert carried and "lexemes" not in carried[1]
    assert sorted((r["lexeme"], r["tf"]) for r in postings.collect()) == [("alpha", 2), ("beta", 1)]


def test_summaries_of_failed_reviews(spark):
    rows = QUERIES["risk_summaries_k7"](spark, FOLDER)
    assert demo.reviews(spark, FOLDER).filter("error IS NOT NULL").count() == rows.filter("risks = 'not assessed'").count() > 0
