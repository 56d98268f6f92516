"""A corpus load that can be repeated: what is missing is ingested, what is there stays, the identifier map is rebuilt."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import privacy
from ..session import cut_lineage
from ..sources import store
from ..sources.tables import Store
from .ingest import ingest

#: Samples are kept for ten years.
SAMPLE_HOURS = 24 * 365 * 10


@dataclass
class Loaded:
    documents: DataFrame
    chunks: DataFrame
    pii_map: DataFrame
    added: dict[str, int]


def load_samples(held: Store, index: DataFrame, pages: DataFrame, commit: str, created_at: Column) -> Loaded:
    """Load the samples of ``index(doc_id, slug, title)`` from ``pages(doc_id, page, text)`` into a store.

    Slugs that the store has no sample of are ingested and added in one commit; the load may run any number of times
    and under any name. Returned are the stored rows of the index' samples and the placeholders of their identifiers: the map
    is never stored, so that of samples which were there is rebuilt from their pages.
    """
    present = held.read("documents").filter("is_sample").select(F.col("sample_slug").alias("slug"))
    missing = index.join(present, "slug", "left_anti")
    added = dict.fromkeys(("documents", "chunks"), 0)
    if commit not in held.snapshot().commits and not missing.isEmpty():
        done = ingest(pages.join(missing.select("doc_id"), "doc_id", "left_semi"), checkpoint=True)
        rows = store.document_rows(done.documents.drop("chunk_count"), done.chunks, created_at, SAMPLE_HOURS)
        named = missing.select("doc_id", "title", F.col("slug").alias("sample_slug"))
        rows = cut_lineage(rows.join(named, "doc_id").withColumn("is_sample", F.lit(True)))
        added = held.add(commit, documents=rows, chunks=done.chunks)
    wanted = index.select(F.col("slug").alias("sample_slug"))
    documents = held.read("documents").filter("is_sample").join(wanted, "sample_slug", "left_semi")
    again = pages.join(documents.select("doc_id"), "doc_id", "left_semi")
    _, pii_map, _ = privacy.mask_documents(again)
    return Loaded(documents, held.read("chunks").join(documents.select("doc_id"), "doc_id", "left_semi"), pii_map, added)


def empty_store(held: Store, pages: DataFrame, created_at: Column) -> None:
    """Lay down the tables that :func:`load_samples` adds to, without rows."""
    done = ingest(pages.limit(0))
    rows = store.document_rows(done.documents.drop("chunk_count"), done.chunks, created_at, SAMPLE_HOURS)
    rows = rows.withColumns({"title": F.lit(""), "sample_slug": F.lit(""), "is_sample": F.lit(True)}).limit(0)
    held.create("create", documents=rows, chunks=done.chunks.limit(0))
