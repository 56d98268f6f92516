import random

from pyspark.sql import functions as F

from clausemill.functions import vectors as V
from clausemill.operators import retrieval

WORDS = ["loan", "charges", "fee", "lender", "tenure", "interest", "penal", "deposit", "notice", "governing"] + [f"word{i}" for i in range(300)]


def corpus(spark):
    draw = random.Random(2)
    rows = [(d, f"{d}:{i}", i, " ".join(draw.choices(WORDS, k=40))) for d in range(20) for i in range(4)] + [(None, "x", 0, "loan"), (3, "3:9", 9, None)]
    chunks = spark.createDataFrame(rows, "doc_id int, chunk_id string, chunk_index int, content string")
    asks = [(f"{d}/{i}", d, q) for d in range(20) for i, q in enumerate(["Loan charges and fees", "the of and", None, "penal interest, notices"])]
    return chunks, spark.createDataFrame(asks, "query_id string, doc_id int, question string")


def test_postings_of_asked_lexemes_only(spark):
    chunks, asks = corpus(spark)
    every = retrieval.postings(chunks)
    terms = {r["lexeme"] for r in retrieval.query_terms(asks).collect()}
    got = retrieval.postings(chunks, asks)
    expected = sorted(map(str, every.filter(F.col("lexeme").isin(*terms)).collect()))
    assert terms and expected and sorted(map(str, got.collect())) == expected
    assert got.count() < every.count() / 5
    assert retrieval.postings(chunks, asks.limit(0)).count() == 0


def test_searches_find_the_same(spark):
    chunks, asks = corpus(spark)
    chunks = chunks.withColumn("embedding", V.hash_embedding(F.coalesce("content", F.lit("")), 64))
    asks = asks.withColumn("vector", V.hash_embedding(F.coalesce("question", F.lit("")), 64))
    found = [sorted(map(str, retrieval.hybrid_search(chunks, asks, 3, posting_table=held).collect())) for held in (None, retrieval.postings(chunks))]
    assert found[0] == found[1] and found[0]
