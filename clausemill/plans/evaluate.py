"""Retrieval scores per retriever and per chunk size over a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import chunking, evaluation, retrieval
from ..session import work_folder

# fixed values: retrievers under comparison as (name, vector weight, text weight)
RETRIEVERS = (("hybrid (RRF)", 1, 1), ("vector only", 1, 0), ("full-text only", 0, 1))
TOP_K = 8


def retriever_scores(chunks: DataFrame, questions: DataFrame, dims: int) -> DataFrame:
    """``(retriever, recall_1, recall_4, recall_8, mrr)`` for ``questions(query_id, doc_id, question, pages)``.

    Both candidate lists are searched once; each retriever is a weighting of them. A question is one of its own for every
    retriever, so that all are fused, ranked and scored at once and nothing is written between.
    """

    own = F.concat(F.col("no").cast("string"), F.lit("/"), F.col("query_id").cast("string"))
    queries = questions.withColumn("vector", V.hash_embedding(F.col("question"), dims))
    lists = retrieval.candidate_lists(chunks, queries, retrieval.candidate_count(TOP_K))
    weights = [
        F.struct(F.lit(no).alias("no"), F.when(F.col("source") == "vector", float(vector)).otherwise(float(text)).alias("weight"))
        for no, (_, vector, text) in enumerate(RETRIEVERS)
    ]
    weighted = lists.drop("weight").select("*", F.inline(F.array(*weights))).withColumn("query_id", own).drop("no")
    hits = retrieval.fused_top_k(weighted, TOP_K).withColumnRenamed("id", "chunk_id")
    found = hits.join(chunks.select("chunk_id", "page_start", "page_end"), "chunk_id")
    numbers = F.explode(F.array(*[F.lit(no) for no in range(len(RETRIEVERS))]))
    # a question without an id counts, and no hit is its own
    named = F.coalesce(own, F.col("no").cast("string"))
    expected = questions.select("query_id", "pages", numbers.alias("no")).select(named.alias("query_id"), "pages")
    first = evaluation.first_hits(expected, found).withColumn("no", F.substring_index("query_id", "/", 1).cast("int"))
    names = chunks.sparkSession.createDataFrame([(no, name) for no, (name, *_) in enumerate(RETRIEVERS)], "no int, retriever string")
    return names.join(evaluation.retrieval_scores(first, ["no"]), "no", "left").drop("no")


def chunk_size_scores(pages: DataFrame, questions: DataFrame, dims: int, sizes=(200, 400, 800)) -> DataFrame:
    """``(max_tokens, chunks, documents, mean_chunks, recall_1, recall_4, recall_8, mrr)`` of hybrid search for every cap.

    ``questions(query_id, doc_id, question, pages)``. All caps are planned in one scan over the pages; a document's chunks of
    one cap are a scope of their own, so that all are searched at once.
    """

    def scoped(column: str) -> Column:
        return F.concat_ws("/", F.col("max_tokens").cast("string"), F.col(column).cast("string"))

    swept = chunking.sweep_chunk_sizes(pages, sizes)
    swept = swept.withColumns({"scope": scoped("doc_id"), "chunk_id": scoped("chunk_id"), "embedding": V.hash_embedding(F.col("content"), dims)})
    folder = work_folder(pages.sparkSession, "swept")  # compressed, and each branch reads its own columns
    swept.write.parquet(folder)
    swept = pages.sparkSession.read.schema(swept.schema).parquet(folder)
    counted = swept.groupBy("max_tokens", "scope").agg(F.count("*").alias("n")).groupBy("max_tokens").agg(
        F.sum("n").alias("chunks"), F.count("*").alias("documents"), F.avg("n").alias("mean_chunks")
    )
    if "vector" not in questions.columns:
        questions = questions.withColumn("vector", V.hash_embedding(F.col("question"), dims))
    each = questions.withColumn("max_tokens", F.explode(F.array(*[F.lit(s) for s in sizes])))
    asked = each.withColumns({"query_id": scoped("query_id"), "doc_id": scoped("doc_id")})
    chunks = swept.drop("doc_id").withColumnRenamed("scope", "doc_id")
    hits = retrieval.hybrid_search(chunks, asked, TOP_K)
    found = hits.join(chunks.select("chunk_id", "page_start", "page_end"), "chunk_id")
    first = evaluation.first_hits(asked.select("query_id", "pages"), found)
    scores = evaluation.retrieval_scores(first.withColumn("max_tokens", F.substring_index("query_id", "/", 1).cast("int")), ["max_tokens"])
    return counted.join(scores, "max_tokens")
