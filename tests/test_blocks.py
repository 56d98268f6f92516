import random
from collections import Counter


from pyspark.sql import functions as F

from __spark_entry__ import QUERIES
from clausemill.operators import blocks
from clausemill.operators.retrieval import query_terms

WORDS = [f"word{n}" for n in range(40)]


def corpus(spark, seed, count=300):
    draw = random.Random(seed)
    rows = []
    for n in range(count):
        length = draw.choice([3, 10, 40, 200])
        rows.append((f"c{n}", n, " ".join(draw.choices(WORDS[:8] if n % 7 else WORDS, k=length))))
    rows += [("empty", 1000, ""), ("null", 1001, None), ("stop", 1002, "the of and")]
    questions = [(f"q{n}", " ".join(draw.choices(WORDS, k=draw.randrange(1, 6)))) for n in range(25)] + [("none", "the of"), ("absent", "zebra")]
    chunks = spark.createDataFrame(rows, "chunk_id string, chunk_index long, content string").repartition(4)
    return rows, questions, chunks, spark.createDataFrame(questions, "query_id string, question string")


def expected(rows, questions, k):
    out = []
    for q, question in questions:
        wanted = set(question.split())
        scores = [(sum(c for w, c in Counter((text or "").split()).items() if w in wanted), index) for _, index, text in rows]
        best = sorted((-s, i) for s, i in scores if s and q not in ("none", "absent"))[:k]
        out += [(q, i, -s, rank) for rank, (s, i) in enumerate(best, 1)]
    return sorted(out)


def test_pruned_search_equals_reading_all(spark):
    for seed, k, first in ((1, 5, 1), (2, 12, 4), (3, 400, 2)):
        rows, questions, chunks, asked = corpus(spark, seed)
        postings = blocks.blocked_postings(chunks, parts=3)
        got = blocks.search(postings, blocks.block_bounds(postings), asked, k, first).collect()
        assert sorted((r["query_id"], r["chunk_index"], r["score"], r["rank"]) for r in got) == expected(rows, questions, k)


def test_blocks_that_cannot_reach_the_bar_are_not_read(spark):
    _, _, chunks, asked = corpus(spark, 4)
    postings = blocks.blocked_postings(chunks, parts=3)
    bounds = blocks.block_bounds(postings)
    terms = query_terms(asked.withColumn("doc_id", F.lit(""))).select("query_id", "lexeme")
    every = terms.join(bounds, "lexeme").select("query_id", "block").distinct().count()
    _, rest = blocks.promising(postings, bounds, terms, 5, 2)
    assert rest.count() < 0.5 * every


def test_empty_corpus(spark):
    _, _, chunks, asked = corpus(spark, 5, 2)
    postings = blocks.blocked_postings(chunks.limit(0))
    assert blocks.search(postings, blocks.block_bounds(postings), asked, 3).count() == 0


def test_only_asked_lexemes_are_posted(spark):
    rows, questions, chunks, asked = corpus(spark, 6)
    few = asked.limit(3)
    postings = blocks.blocked_postings(chunks, parts=3, queries=few)
    words = {w for _, question in questions[:3] for w in question.split()}
    assert {r["lexeme"] for r in postings.select("lexeme").distinct().collect()} == words & set(WORDS)
    every = blocks.blocked_postings(chunks, parts=3)
    assert sorted(map(str, every.join(postings.select("lexeme").distinct(), "lexeme").select(postings.columns).collect())) == sorted(map(str, postings.collect()))
    got = blocks.search(postings, blocks.block_bounds(postings), few, 7, 1).collect()
    assert sorted((r["query_id"], r["chunk_index"], r["score"], r["rank"]) for r in got) == expected(rows, questions[:3], 7)


def test_postings_are_kept_by_columns(spark, monkeypatch):
    """The corpus is not posted in full, and not written as rows."""
    held = []
    search = blocks.search
    monkeypatch.setattr(blocks, "search", lambda postings, *a: held.append(postings) or search(postings, *a))
    assert QUERIES["benchmark_text_search_r7"](spark, "/root/testdata/sf0.001").count() > 0
    assert "parquet" in held[0]._jdf.queryExecution().executedPlan().toString().lower()
