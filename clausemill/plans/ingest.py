"""Pages to masked, chunked, classified documents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import chunking, classify, layout, privacy
from ..session import cut_lineage


@dataclass
class Ingested:
    documents: DataFrame
    chunks: DataFrame
    pii_map: DataFrame
    rejects: DataFrame


def mask_and_chunk(pages: DataFrame, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(per-document chunk arrays with content_hash, placeholders, spans)`` of gated pages.

    Identifiers are masked before anything else sees the text.
    """
    masked, placeholders, found = privacy.mask_documents(pages)
    gathered = masked.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("pages"))
    texts = F.transform("pages", lambda p: p.text)
    with_lines = chunking.lines_in_row(
        gathered.withColumn("content_hash", X.fingerprint(texts)), F.col("pages"), ["doc_id", "content_hash"]
    )
    return chunking.chunk_arrays(with_lines, **options), placeholders, found


def ingest(
    pages: DataFrame, uploads: DataFrame | None = None, max_pages: int = layout.MAX_PAGES, checkpoint: bool = False,
    **options,
) -> Ingested:
    """The whole flow for ``pages(doc_id, page, text)`` and, if given, ``uploads(doc_id, file_name, mime_type)``.

    Documents over the page limit, without text or without any page go to ``rejects``; what remains is bounded per document.
    With ``checkpoint`` the chunked documents are written once to the shared checkpoint folder, so that
    writing several of the result tables does not mask and chunk the corpus again for each.
    """
    source = F.lit("pdf")
    rejects = None
    typed = None
    if uploads is not None:
        typed = layout.uploads_with_type(uploads)
        rejects = typed.filter("reject IS NOT NULL").select("doc_id", "reject")
        known = typed.filter("reject IS NULL").select("doc_id", "source_type")
        pages = pages.join(known, "doc_id")
        source = F.col("source_type")
    quality = layout.page_quality(pages, source, max_pages)
    if checkpoint:
        quality = cut_lineage(quality)
    gated = layout.accepted_pages(pages.select("doc_id", "page", "text"), quality)
    chunked, placeholders, _ = mask_and_chunk(gated, **options)
    if checkpoint:
        chunked, placeholders = cut_lineage(chunked), cut_lineage(placeholders)
    hashed = chunked.select("doc_id", "content_hash", F.size("chunks").alias("chunk_count"))
    chunks = chunking.explode_chunks(chunked)
    kinds = classify.classify_chunks(chunks)
    empty = hashed.filter("chunk_count = 0").select("doc_id", F.lit("EMPTY_DOCUMENT").alias("reject"))
    bad = quality.filter("reject IS NOT NULL").select("doc_id", "reject").unionByName(empty)
    rejects = bad if rejects is None else rejects.unionByName(bad)
    documents = (
        hashed.filter("chunk_count > 0")
        .join(kinds.select("doc_id", "kind"), "doc_id")
        .join(quality.select("doc_id", "source_type", F.col("page_count").cast("int").alias("page_count"), "warning"), "doc_id")
        .withColumn("status", F.lit("parsed"))
    )
    if typed is not None:
        documents = documents.join(typed.select("doc_id", "title"), "doc_id")
        pageless = known.join(quality.select("doc_id"), "doc_id", "left_anti")
        code = F.when(F.col("source_type") == "pdf", "SCANNED_PDF").otherwise("EMPTY_DOCUMENT")
        rejects = rejects.unionByName(pageless.select("doc_id", code.alias("reject")))
    return Ingested(documents, chunks, placeholders, rejects)
