"""Document kind from the density of loan and contract wording."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X

# fixed values: hits per 1,000 words and distinct signals an agreement, then a loan, must reach
AGREEMENT_DENSITY, AGREEMENT_SIGNALS = 10.0, 4
LOAN_DENSITY, LOAN_DISTINCT = 12.0, 5


def signal_counts(text: Column, loan=P.LOAN_SIGNALS, contract=P.CONTRACT_SIGNALS) -> list[Column]:
    """Word count and one hit count per signal of a lower-cased text; literal patterns compile once per task."""
    named = [X.word_count(text).alias("words")]
    named += [X.pattern_hits(text, p).alias(f"loan_{i}") for i, p in enumerate(loan)]
    named += [X.pattern_hits(text, p).alias(f"contract_{i}") for i, p in enumerate(contract)]
    return named


def keyword_density(hits: list[Column], words: Column) -> tuple[Column, Column]:
    """Hits per 1,000 words and the number of signals that occur at all."""
    total = sum(hits[1:], hits[0])
    distinct = sum(((h > 0).cast("int") for h in hits[1:]), (hits[0] > 0).cast("int"))
    return total / F.greatest(words, F.lit(1)) * 1000, distinct


def _one_decimal(x: Column) -> Column:
    return F.floor(x * 10 + 0.5) / 10


def classify_chunks(chunks: DataFrame, loan=P.LOAN_SIGNALS, contract=P.CONTRACT_SIGNALS) -> DataFrame:
    """``(doc_id, kind, loan_density, contract_density, loan_signals)``.

    No signal spans a chunk boundary, so per-chunk counts add up and combine map-side: a document with
    very many chunks sends one small row per task.
    """
    lowered = chunks.select("doc_id", F.lower("content").alias("content"))
    counted = lowered.select("doc_id", *signal_counts(F.col("content"), loan, contract))
    sums = counted.groupBy("doc_id").agg(*[F.sum(c).alias(c) for c in counted.columns if c != "doc_id"])
    loan_hits = [F.col(f"loan_{i}") for i in range(len(loan))]
    contract_hits = [F.col(f"contract_{i}") for i in range(len(contract))]
    ld, ls = keyword_density(loan_hits, F.col("words"))
    cd, cs = keyword_density(contract_hits, F.col("words"))
    scored = sums.select("doc_id", ld.alias("ld"), ls.alias("ls"), cd.alias("cd"), cs.alias("cs"))
    is_agreement = (F.col("cd") >= AGREEMENT_DENSITY) & (F.col("cs") >= AGREEMENT_SIGNALS)
    is_loan = (F.col("ld") >= LOAN_DENSITY) & (F.col("ls") >= LOAN_DISTINCT)
    kind = F.when(is_agreement & is_loan, "loan").when(is_agreement, "contract").otherwise("general")
    return scored.select(
        "doc_id", kind.alias("kind"), _one_decimal(F.col("ld")).alias("loan_density"),
        _one_decimal(F.col("cd")).alias("contract_density"), F.col("ls").alias("loan_signals"),
    )
