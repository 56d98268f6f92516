"""Loan terms with cost, contract facts and risk flags for a corpus, around two model tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import answers, extraction, retrieval, risks

LOAN_ASK = "Extract the loan terms as JSON."
CONTRACT_ASK = "Extract the key facts as JSON."
OUTLINE_ASK = "Produce the outline as JSON."
LOAN_TOP_K, CONTRACT_TOP_K = 6, 5


def field_context(documents: DataFrame, chunks: DataFrame, questions, dims: int, k: int) -> DataFrame:
    """Union of the field queries' top chunks per document, in document order, at most forty."""
    queries = retrieval.field_queries(documents.select("doc_id"), questions, dims)
    return retrieval.union_context(retrieval.hybrid_search(chunks, queries, k), chunks)


def extraction_requests(documents: DataFrame, chunks: DataFrame, dims: int) -> DataFrame:
    """Prompts per document by kind: ``(doc_id, passages, prompt, analysis)``."""
    routed = extraction.route_by_kind(documents)
    loan = field_context(routed["terms"], chunks, retrieval.LOAN_QUERIES, dims, LOAN_TOP_K)
    contract = field_context(routed["facts"], chunks, retrieval.CONTRACT_QUERIES, dims, CONTRACT_TOP_K)
    head = retrieval.head_context(chunks.join(routed["outline"].select("doc_id"), "doc_id", "left_semi"))
    parts = [
        (answers.contexts(loan, "doc_id"), LOAN_ASK, "terms"),
        (answers.contexts(contract, "doc_id"), CONTRACT_ASK, "facts"),
        (answers.contexts(head, "doc_id", outline=True), OUTLINE_ASK, "outline"),
    ]
    tables = [answers.extraction_prompts(c, ask).withColumn("analysis", F.lit(name)) for c, ask, name in parts]
    return tables[0].unionByName(tables[1]).unionByName(tables[2])


def loan_costs(responses: DataFrame, passages: DataFrame) -> DataFrame:
    """Resolved, costed loan terms of ``responses(doc_id, raw)``."""
    parsed = extraction.parse_output(responses, extraction.LOAN)
    return extraction.cost_from_terms(extraction.loan_terms(parsed, passages))


def risk_flags(chunks: DataFrame, responses: DataFrame) -> DataFrame:
    """Ordered flags per document from the candidates and ``responses(doc_id, raw)``."""
    candidates = risks.find_candidates(chunks)
    return risks.flag_order(risks.resolve_reviews(risks.parse_reviews(responses), candidates))
