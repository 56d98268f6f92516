"""Content-addressed embeddings: look up, embed distinct misses, append, join back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V

BATCH_SIZE = 32
HASH_MODEL = "feature-hash"


def with_keys(texts: DataFrame, model: str, dims: int, task: str, text: str = "text") -> DataFrame:
    key = X.embedding_key(F.lit(model), F.lit(dims), F.lit(task), F.col(text))
    return texts.withColumn("content_hash", key)


def missing_keys(keyed: DataFrame, cache: DataFrame, text: str = "text") -> DataFrame:
    """Distinct ``(content_hash, text)`` without a cached vector; repeats collapse before the shuffle."""
    distinct = keyed.groupBy("content_hash").agg(F.first(text).alias(text))
    return distinct.join(cache.select("content_hash"), "content_hash", "left_anti")


def number_in_key_order(df: DataFrame, key: str = "content_hash", prefix: int = 3) -> DataFrame:
    """Add a dense ``row_no`` from 0 in the order of a hex digest, without a one-task sort.

    The digest's first characters split the rows evenly into 16^prefix ranges; only the ranges' counts
    (a fixed number of rows) pass through one window.
    """
    ranged = df.withColumn("_range", F.substring(key, 1, prefix))
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("_range").orderBy(key)
    numbered = ranged.withColumn("_at", F.row_number().over(within)).join(offsets, "_range")
    return numbered.withColumn("row_no", F.col("_offset") + F.col("_at") - 1).drop("_range", "_at", "_offset")


def embedding_requests(keyed: DataFrame, cache: DataFrame, text: str = "text", batch_size: int = BATCH_SIZE) -> DataFrame:
    """The request table of an external model: distinct misses in batches of ``batch_size``."""
    numbered = number_in_key_order(missing_keys(keyed, cache, text))
    return numbered.withColumn("batch_no", F.floor(F.col("row_no") / batch_size)).drop("row_no")


def hash_responses(requests: DataFrame, dims: int, text: str = "text") -> DataFrame:
    """Answer a request table with the offline feature-hashed vectors."""
    return requests.select("content_hash", V.hash_embedding(F.col(text), dims).alias("embedding"))


def accept_vectors(responses: DataFrame, dims: int) -> tuple[DataFrame, DataFrame]:
    """Responses of the configured size, and rejects."""
    size = F.coalesce(F.size("embedding"), F.lit(-1))
    return responses.filter(size == dims), responses.filter(size != dims).withColumn("size", size)


def unanswered(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Requests without a response: an incomplete batch is rejected, not used in part."""
    return requests.join(responses.select("content_hash"), "content_hash", "left_anti")


def grow_cache(cache: DataFrame, fresh: DataFrame, model: str) -> DataFrame:
    """Append vectors whose key is not in the cache yet."""
    new = fresh.dropDuplicates(["content_hash"]).join(cache.select("content_hash"), "content_hash", "left_anti")
    return cache.unionByName(new.select("content_hash", F.lit(model).alias("model"), "embedding"))


def embed_rows(
    rows: DataFrame, cache: DataFrame, dims: int, task: str = "RETRIEVAL_DOCUMENT", model: str = HASH_MODEL,
    text: str = "content", responder=hash_responses,
) -> tuple[DataFrame, DataFrame]:
    """``(rows with embedding, grown cache)``; equal texts share one vector and one request."""
    keyed = with_keys(rows, model, dims, task, text)
    fresh = responder(missing_keys(keyed, cache, text), dims, text)
    grown = grow_cache(cache, fresh, model)
    return keyed.join(grown.select("content_hash", "embedding"), "content_hash", "left"), grown


def embedding_stats(keyed: DataFrame, cache: DataFrame, batch_size: int = BATCH_SIZE) -> DataFrame:
    """One row: inputs requested, distinct keys hit, calls for the distinct misses."""
    known = cache.select("content_hash", F.lit(1).alias("hit"))
    per_key = keyed.groupBy("content_hash").agg(F.count("*").alias("n")).join(known, "content_hash", "left")
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("requested"),
        F.count("hit").alias("cache_hits"),
        F.ceil(F.count_if(F.col("hit").isNull()) / batch_size).alias("api_calls"),
    )


def embed_missing(chunks: DataFrame, cache: DataFrame, dims: int, **options) -> tuple[DataFrame, DataFrame]:
    """Resume: chunks that have a vector keep it, only the others are looked up or embedded."""
    done = chunks.filter(F.col("embedding").isNotNull())
    todo = chunks.filter(F.col("embedding").isNull()).drop("embedding")
    embedded, grown = embed_rows(todo, cache, dims, **options)
    return done.unionByName(embedded.select(*chunks.columns)), grown


def embedded_status(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents become ``embedded`` when none of their chunks lacks a vector."""
    open_docs = chunks.filter(F.col("embedding").isNull()).select("doc_id").distinct()
    pending = open_docs.withColumn("_open", F.lit(True))
    joined = documents.join(pending, "doc_id", "left")
    status = F.when(F.col("_open"), F.col("status")).otherwise("embedded")
    return joined.withColumn("status", status).drop("_open")
