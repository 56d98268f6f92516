"""Questions to request tables, and model responses to cited answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import answers, retrieval


def retrieve(asks: DataFrame, chunks: DataFrame, dims: int, k: int = 8, **weights) -> DataFrame:
    """Passages ``(query_id, rank, chunk columns)`` of every question; ``chunks`` hold embeddings."""
    queries = asks.withColumn("vector", V.hash_embedding(F.col("question"), dims))
    hits = retrieval.hybrid_search(chunks, queries, k, **weights)
    return retrieval.with_chunk_columns(hits, chunks)


def requests(asks: DataFrame, passages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(prompts for the model, refusals of questions that retrieved nothing)``."""
    prompts = answers.question_prompts(answers.contexts(passages), asks)
    return prompts, answers.no_context_answers(asks, passages)


def cited_answers(responses: DataFrame, passages: DataFrame, tool_calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(answers with groundedness, citation rows)`` for ``responses(query_id, raw)`` and
    ``tool_calls(query_id, tool_calls)``."""
    counts = passages.groupBy("query_id").agg(F.count("*").cast("int").alias("passages"))
    numbered = responses.join(counts, "query_id", "left").fillna(0, ["passages"])
    parsed = answers.parse_answers(numbered).join(tool_calls, "query_id", "left").fillna(0, ["tool_calls"])
    grounded = answers.grounded(F.col("refs"), F.col("not_found"), F.col("tool_calls"))
    return parsed.withColumn("grounded", grounded), answers.resolve_citations(parsed, passages)
