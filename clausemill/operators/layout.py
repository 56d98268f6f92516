"""Pages out of positioned text runs, raw text and upload records."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

LINE_TOLERANCE = 2.5
MIN_PAGE_CHARS = 25
MAX_PAGES = 60


def _line_of_each_run(y: pd.Series) -> list[int]:
    """Index of the earliest opened line whose first run lies within the tolerance of each run."""
    anchors: list[float] = []
    chosen = []
    for value in y:
        hit = next((i for i, a in enumerate(anchors) if abs(a - value) <= LINE_TOLERANCE), None)
        if hit is None:
            hit = len(anchors)
            anchors.append(value)
        chosen.append(hit)
    return chosen


def runs_to_pages(runs: DataFrame) -> DataFrame:
    """``runs(doc_id, page, seq, x, y, str)`` to ``pages(doc_id, page, text)`` in reading order.

    Only the line choice depends on the order of the runs, so only ``y`` travels through Python: one page is
    gathered as an array (a page is bounded by what fits on it) and the text never leaves the JVM.
    """
    from pyspark.sql.types import ArrayType, IntegerType

    @F.pandas_udf(ArrayType(IntegerType()))
    def lines_for(ys: pd.Series) -> pd.Series:
        return ys.map(lambda y: _line_of_each_run(y) if y is not None else [])

    visible = runs.filter(T.strip_ws("str") != "")
    item = F.struct("seq", "x", "y", "str")
    page = visible.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(item)).alias("items"))
    page = page.withColumn("line", lines_for.asNondeterministic()(F.transform("items", lambda i: i.y)))
    placed = F.arrays_zip("items", "line")
    # a line sorts by its first run: highest first, earlier opened first; runs by x, then arrival
    rows = F.transform(
        F.array_sort(
            F.transform(
                F.array_distinct("line"),
                lambda n: F.struct(
                    (-F.element_at(F.filter(placed, lambda p: p.line == n), 1).items.y).alias("neg_y"),
                    n.alias("line"),
                ),
            )
        ),
        lambda r: F.array_join(
            F.transform(
                F.array_sort(
                    F.transform(
                        F.filter(placed, lambda p: p.line == r.line),
                        lambda p: F.struct(p.items.x.alias("x"), p.items.seq.alias("seq"), p.items.str.alias("str")),
                    )
                ),
                lambda i: i.str,
            ),
            " ",
        ),
    )
    text = F.array_join(F.transform(rows, T.collapse_ws), "\n")
    return page.select("doc_id", "page", text.alias("text"))


def uploads_with_type(uploads: DataFrame) -> DataFrame:
    """Add ``source_type``, ``title`` and a ``reject`` code to ``uploads(doc_id, file_name, mime_type)``."""
    kind = T.source_type(F.col("mime_type"), F.col("file_name"))
    return uploads.select(
        "*",
        kind.alias("source_type"),
        T.title_from_file_name("file_name").alias("title"),
        F.when(kind.isNull(), "UNSUPPORTED_TYPE").alias("reject"),
    )


def raw_to_pages(raw: DataFrame) -> DataFrame:
    """``raw(doc_id, text)`` without pages: the normalised text is page 1."""
    return raw.select("doc_id", F.lit(1).alias("page"), T.normalise_raw_text("text").alias("text"))


def page_quality(pages: DataFrame, source_type: Column | str = "pdf", max_pages: int = MAX_PAGES) -> DataFrame:
    """One row per document: page counts, a reject code or a warning about pages without text."""
    chars = T.visible_length("text")
    kind = F.lit(source_type) if isinstance(source_type, str) else source_type
    per_doc = pages.groupBy("doc_id").agg(
        F.count("*").alias("page_count"),
        F.count_if(chars >= MIN_PAGE_CHARS).alias("text_pages"),
        F.max(kind).alias("source_type"),
    )
    total, textual = F.col("page_count"), F.col("text_pages")
    is_pdf = F.col("source_type") == "pdf"
    reject = F.when(is_pdf & (total > max_pages), "TOO_MANY_PAGES").when(
        textual == 0, F.when(is_pdf, "SCANNED_PDF").otherwise("EMPTY_DOCUMENT")
    )
    warning = F.when(
        is_pdf & reject.isNull() & (textual < total),
        F.concat(
            (total - textual).cast("string"), F.lit(" of "), total.cast("string"),
            F.lit(" pages had no extractable text and were skipped."),
        ),
    )
    return per_doc.select("*", reject.alias("reject"), warning.alias("warning"))


def accepted_pages(pages: DataFrame, quality: DataFrame) -> DataFrame:
    """Pages of documents that passed the gate. After it a document holds at most ``MAX_PAGES`` pages,
    which bounds every later per-document group."""
    return pages.join(quality.filter("reject IS NULL").select("doc_id"), "doc_id", "left_semi")


def page_lines(pages: DataFrame) -> DataFrame:
    """``(doc_id, page, line_no, text)``: non-blank collapsed lines, numbered from 0 within their page."""
    return pages.select("doc_id", "page", F.posexplode(T.text_lines("text")).alias("line_no", "text"))


def document_line_order() -> Window:
    return Window.partitionBy("doc_id").orderBy("page", "line_no")
