"""Upload-by-upload ingest: page files arrive, each micro-batch runs the batch flow.

One file holds whole documents. Every batch writes to folders named by its id with overwrite, so a batch
that is replayed after a lost executor or driver replaces its own output and nothing is written twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..operators import embedding
from ..plans.ingest import ingest


def ingest_uploads(
    spark: SparkSession, source: str, target: str, checkpoint: str, schema: str = schemas.PAGES,
    files: str = "*.parquet", files_per_batch: int | None = None,
    prepare: Callable[[DataFrame], DataFrame] | None = None, **options,
) -> StreamingQuery:
    """Read new page files under ``source`` and write chunks, documents, maps and rejects under ``target``.

    ``prepare`` turns files of another shape into ``(doc_id, page, text)``.
    """
    reader = spark.readStream.schema(schema).option("pathGlobFilter", files)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def run(rows: DataFrame, batch_id: int) -> None:
        pages = prepare(rows) if prepare else rows
        done = ingest(pages, checkpoint=True, **options)
        parts = [("chunks", done.chunks), ("pii_map", done.pii_map), ("rejects", done.rejects), ("documents", done.documents)]
        for name, table in parts:
            table.write.mode("overwrite").parquet(f"{target}/{name}/batch={batch_id}")

    stream = reader.parquet(source)
    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def embed_chunks(
    spark: SparkSession, source: str, target: str, checkpoint: str, dims: int, schema: str = schemas.CHUNKS,
    files: str = "*.parquet", files_per_batch: int | None = None,
    prepare: Callable[[DataFrame], DataFrame] | None = None,
) -> StreamingQuery:
    """Embed chunk files as they arrive; keys already cached by earlier batches are not requested again.

    The cache is read from the folders of earlier batches, so a replayed batch sees what it saw before.
    """
    reader = spark.readStream.schema(schema).option("pathGlobFilter", files)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def run(rows: DataFrame, batch_id: int) -> None:
        chunks = prepare(rows) if prepare else rows
        session = chunks.sparkSession
        empty = session.createDataFrame([], schemas.EMBEDDING_CACHE)

        def cached_before(limit: int) -> DataFrame:
            # the folder name is a partition column: only earlier batches are listed and read
            stored = session.read.schema(schemas.EMBEDDING_CACHE + ", batch long").parquet(f"{target}/cache")
            return stored.filter(F.col("batch") < limit).drop("batch")

        cache = cached_before(batch_id) if batch_id else empty
        keyed = embedding.with_keys(chunks, embedding.HASH_MODEL, dims, "RETRIEVAL_DOCUMENT", "content")
        fresh = embedding.hash_responses(embedding.missing_keys(keyed, cache, "content"), dims, "content")
        new = embedding.grow_cache(empty, fresh, embedding.HASH_MODEL)
        new.write.mode("overwrite").parquet(f"{target}/cache/batch={batch_id}")
        vectors = cached_before(batch_id + 1).select("content_hash", "embedding")
        keyed.join(vectors, "content_hash", "left").write.mode("overwrite").parquet(f"{target}/chunks/batch={batch_id}")

    stream = reader.parquet(source)
    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
