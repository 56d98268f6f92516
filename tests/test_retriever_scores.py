"""Retrievers are weightings of the same lists: scored at once, they get what each gets by itself."""

import random

from pyspark.sql import functions as F

from clausemill.functions import vectors as V
from clausemill.operators import evaluation, retrieval
from clausemill.plans import evaluate

WORDS = "fee rate loan term notice rent lender charge penal key".split()


def tables(spark, documents):
    pick = random.Random(4)
    chunks = [(d, f"{d}:{i}", i, " ".join(pick.choices(WORDS, k=6)), i // 2 + 1, i // 2 + 1) for d in range(documents) for i in range(14)]
    questions = [(f"{d}/q{n}" if n else None, d, " ".join(pick.choices(WORDS, k=2)), [d % 3 + 1]) for d in range(documents) for n in range(4)]
    chunks = spark.createDataFrame(chunks, "doc_id long, chunk_id string, chunk_index int, content string, page_start int, page_end int")
    return chunks.withColumn("embedding", V.hash_embedding(F.col("content"), 16)), spark.createDataFrame(questions, "query_id string, doc_id long, question string, pages array<int>")


def one(chunks, questions, vector, text):
    """A retriever that searches by itself."""
    queries = questions.withColumn("vector", V.hash_embedding(F.col("question"), 16))
    hits = retrieval.hybrid_search(chunks, queries, evaluate.TOP_K, vector, text).join(chunks.select("chunk_id", "page_start", "page_end"), "chunk_id")
    return evaluation.retrieval_scores(evaluation.first_hits(questions, hits)).first()


def test_scores_of_each_retriever(spark, monkeypatch):
    chunks, questions = tables(spark, 6)
    fused = []
    top = retrieval.fused_top_k
    monkeypatch.setattr(retrieval, "fused_top_k", lambda *a: fused.append(1) or top(*a))
    got = {r["retriever"]: r for r in evaluate.retriever_scores(chunks, questions, 16).collect()}
    assert len(fused) == 1  # not once for every retriever
    assert set(got) == {name for name, *_ in evaluate.RETRIEVERS}
    for name, vector, text in evaluate.RETRIEVERS:
        want = one(chunks, questions, vector, text)
        assert [round(got[name][c], 9) for c in ("recall_1", "recall_4", "recall_8", "mrr")] == [round(x, 9) for x in want]


def test_without_questions_every_retriever_has_a_row(spark):
    chunks, questions = tables(spark, 1)
    got = evaluate.retriever_scores(chunks, questions.limit(0), 16).collect()
    assert sorted(r["retriever"] for r in got) == sorted(name for name, *_ in evaluate.RETRIEVERS)
    assert all(r["mrr"] is None for r in got)
