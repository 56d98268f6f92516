import random

import pytest
from pyspark.sql import functions as F

from clausemill.operators import chunking
from clausemill.operators.segments import Planner

COLUMNS = ["doc_id", "chunk_index", "clause_title", "page_start", "page_end", "content", "token_count"]


def rows(chunks):
    return sorted((tuple(r[c] for c in COLUMNS) for r in chunks.collect()), key=repr)


def corpus(seed):
    draw = random.Random(seed)
    words = "Lender shall. Pay; Rs. 5 the Borrower: within (30) days No. 7 of notice".split()
    pages = []
    for doc in range(25):
        for page in range(1, draw.randrange(2, 9)):
            lines = []
            for _ in range(draw.randrange(12)):
                kind = draw.random()
                if kind < 0.15:
                    lines.append(draw.choice(["ARTICLE IV", "3.1 Rate of Interest", "SECTION 2: TERMS", "SCHEDULE A"]))
                elif kind < 0.25:
                    lines.append(draw.choice(["", "   ", "short"]))
                else:
                    lines.append(" ".join(draw.choices(words, k=draw.randrange(1, 60))))
            pages.append((doc, page, "\n".join(lines) if lines else draw.choice(["", " \n "])))
    return pages


@pytest.mark.parametrize("options", [(400, 60, 15), (60, 9, 15), (20, 0, 0), (30, 100, 40), (5, 2, 15)])
def test_scan_equals_the_form_of_one_row_per_document(spark, options):
    pages = spark.createDataFrame(corpus(3), "doc_id long, page int, text string").repartition(5)
    in_row = chunking.explode_chunks(chunking.chunk_arrays(chunking.document_lines(pages), *options))
    assert rows(chunking.chunk_documents(pages, *options)) == rows(in_row)


def test_sections_equal_the_form_of_one_row_per_document(spark):
    pages = spark.createDataFrame(corpus(4), "doc_id long, page int, text string").repartition(5)
    for least in (0, 15):
        got = chunking.page_sections(pages, least)
        expected = chunking.sections(chunking.document_lines(pages), least)
        assert sorted(map(repr, got.select(*expected.columns).collect())) == sorted(map(repr, expected.collect()))


def test_all_caps_from_one_scan(spark):
    pages = spark.createDataFrame(corpus(5), "doc_id long, page int, text string")
    swept = chunking.sweep_chunk_sizes(pages, (60, 200))
    for size, overlap in ((60, 9), (200, 30)):
        assert rows(swept.filter(F.col("max_tokens") == size)) == rows(chunking.chunk_documents(pages, size, overlap))


def test_keys_of_other_types_null_keys_and_empty_tables(spark):
    pages = spark.createDataFrame([("a", 1, "ARTICLE I\nSome text of a clause."), (None, 1, "Text without a key."), (None, 2, None)], "doc_id string, page int, text string")
    got = {(r["doc_id"], r["content"]) for r in chunking.chunk_documents(pages).collect()}
    assert got == {("a", "ARTICLE I\nSome text of a clause."), (None, "Text without a key.")}
    assert chunking.chunk_documents(pages.limit(0)).count() == 0


def test_a_document_of_many_pages_holds_one_window(spark):
    planner, most, parts = Planner(400, 60, 15), 0, 0
    for page in range(100_000):
        parts += len(list(planner.page(page, [80] * 10, [None] * 10, [[40, 39]] * 10)))
        most = max(most, len(planner.unit.pieces) + len(planner.unit.lines))
    parts += len(list(planner.close()))
    assert most < 100 and planner.number > 60_000
    pages = spark.range(1, 4001).select(F.lit(1).alias("doc_id"), F.col("id").cast("int").alias("page"), F.lit("One sentence here. Another one.\n" * 9).alias("text"))
    chunks = chunking.chunk_documents(pages)
    assert chunks.agg(F.min("page_start"), F.max("page_end"), F.count("*") > 1000, F.max("token_count") <= 400).first()[:] == (1, 4000, True, True)
