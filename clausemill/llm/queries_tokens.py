"""Token ids of ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from .registry import query, table
from .token_counts import token_counts
from .word_bpe import decode, encode


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op10_bpe")
def bpe(spark, folder):
    path = vocabulary_path("word_bpe_49k.json")
    encoded = encode(table(spark, folder, "documents"), path)
    digests = F.struct(
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256")
    )
    keyed = encoded.select(F.struct("doc_id", digests.alias("digests")).alias("key"), "ids")
    return decode(keyed, path, key="key").select(
        "key.doc_id", "key.digests.n_tokens", "key.digests.ids_sha256",
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


@query("op3_token_counts")
def counts(spark, folder):
    return token_counts(table(spark, folder, "documents"), vocabulary_path("piece_bpe_32k.model"))
