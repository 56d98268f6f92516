"""Two tokenizers' cuts of ``documents``, aligned."""

from __future__ import annotations

from pyspark.sql import functions as F

from .alignment import align
from .queries_tokens import vocabulary_path
from .registry import query, table


@query("op12_tokenizer_alignment")
def tokenizer_alignment(spark, folder):
    found = align(table(spark, folder, "documents"), vocabulary_path("byte_bpe_50k.json"), vocabulary_path("piece_bpe_32k.model"))
    digest = F.when(F.col("groups") == "", F.lit("")).otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))
