"""Clause-aware chunks with page ranges.

Documents of any length are chunked by a scan over their pages (:mod:`.segments`). Behind the upload's page limit a
document's lines may sit in one row, so that its sections, chunks and hash need no shuffle beyond the one that brings
its pages together; there the planning sees line and sentence lengths in Arrow batches. Text stays in the JVM in both.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from . import segments

MAX_TOKENS, OVERLAP_TOKENS, MIN_TOKENS = 400, 60, 15

_WINDOW = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("size", T.IntegerType())])
_UNIT = T.StructType(
    [
        T.StructField("line", T.IntegerType()),
        T.StructField("lines", T.IntegerType()),
        T.StructField("windows", T.ArrayType(_WINDOW)),
    ]
)


def _tokens(chars: int) -> int:
    return -(-chars // 4)


def _units(chars, headings, min_tokens: int) -> list[tuple[int, int, int]]:
    """``(first line, line count, characters)`` per section after folding short ones into the next."""
    starts = [i for i in range(len(chars)) if i == 0 or headings[i]]
    bounds = list(zip(starts, starts[1:] + [len(chars)]))
    units, first = [], None
    for at, (lo, hi) in enumerate(bounds):
        first = lo if first is None else first
        size = int(sum(chars[first:hi])) + hi - first - 1
        if _tokens(size) < min_tokens and at + 1 < len(bounds):
            continue
        units.append((first, hi - first, size))
        first = None
    return units


def _windows(costs: list[int], head: int, max_tokens: int, overlap: int) -> list[tuple[int, int]]:
    """``(start, size)`` windows over segment costs: each as long as the cap allows, at least one segment, and each next
    one starting where the last ``overlap`` tokens of the one before begin, but later than that one did.

    Positions are looked up in the running total of the costs.
    """
    total = np.concatenate(([0], np.cumsum(costs)))
    last = len(costs)
    out, start = [], 0
    while True:
        fits = int(np.searchsorted(total, total[start] + max_tokens - head, side="right")) - 1
        end = min(last, max(start + 1, fits))
        out.append((start, end - start))
        if end == last:
            return out
        shared = int(np.searchsorted(total, total[end] - overlap, side="right")) - 1
        start = max(start + 1, min(end, shared))


def _planner(max_tokens: int | None, overlap: int, min_tokens: int):
    @F.pandas_udf(T.ArrayType(_UNIT))
    def plan(chars: pd.Series, headings: pd.Series, pieces: pd.Series) -> pd.Series:
        def one(c, h, p):
            plans = []
            for line, count, size in _units(c, h, min_tokens):
                windows = []
                if max_tokens is not None and _tokens(size) > max_tokens:
                    titles = [int(c[i]) for i in range(line, line + count) if h[i]]
                    title_chars = sum(titles) + 3 * (len(titles) - 1) if titles else 0
                    head = _tokens(title_chars) + 1 if titles else 0
                    costs = [_tokens(int(n)) + 1 for i in range(line, line + count) for n in p[i]]
                    windows = [{"start": s, "size": n} for s, n in _windows(costs, head, max_tokens, overlap)]
                plans.append({"line": line, "lines": count, "windows": windows})
            return plans

        return pd.Series([one(c, h, p) for c, h, p in zip(chars, headings, pieces)], dtype=object)

    # keeps later filters from being pushed into, and repeating, this step
    return plan.asNondeterministic()


def document_lines(pages: DataFrame) -> DataFrame:
    """``(doc_id, lines)``: all lines of a document in page order with their heading flag; one row holds a document."""
    gathered = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("pages"))
    return lines_in_row(gathered, F.col("pages"), ["doc_id"])


def lines_in_row(df: DataFrame, pages: Column, keep: list[str]) -> DataFrame:
    lines = F.flatten(
        F.transform(
            pages,
            lambda p: F.transform(
                X.text_lines(p.text), lambda t: F.struct(p.page.alias("page"), t.alias("text"), X.is_heading(t).alias("heading"))
            ),
        )
    )
    return df.select(*keep, lines.alias("lines"))


def _plan(df: DataFrame, max_tokens: int | None, overlap: int, min_tokens: int) -> DataFrame:
    """Without ``max_tokens`` no section is split. A document below the cap has no section above it, so its sentences
    are not needed and not cut."""
    lines = F.col("lines")
    size = F.aggregate(lines, F.lit(0), lambda a, l: a + F.length(l.text) + 1)
    long_enough = F.lit(False) if max_tokens is None else size > 4 * max_tokens
    no_pieces = F.array().cast("array<string>")
    df = df.withColumn(
        "pieces", F.transform(lines, lambda l: F.when(long_enough, X.sentences(l.text)).otherwise(no_pieces))
    )
    plan = _planner(max_tokens, overlap, min_tokens)(
        F.transform(lines, lambda l: F.length(l.text)),
        F.transform(lines, lambda l: l.heading),
        F.transform("pieces", lambda p: F.transform(p, F.length)),
    )
    return df.withColumn("plan", plan)


def _title(lines: Column) -> Column:
    joined = F.array_join(F.transform(F.filter(lines, lambda l: l.heading), lambda l: l.text), " > ")
    return F.nullif(joined, F.lit(""))


def _unit_lines(u: Column) -> Column:
    return F.slice(F.col("lines"), u.line + 1, u.lines)


def sections(doc_lines: DataFrame, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """``(doc_id, section_no, title, page_start, page_end, content, token_count)`` before any splitting.

    ``min_tokens=0`` leaves the sections as the headings cut them, without folding.
    """
    keep = [c for c in doc_lines.columns if c != "lines"]
    planned = _plan(doc_lines, None, 0, min_tokens)
    unit = planned.select(*keep, "lines", F.posexplode("plan").alias("section_no", "unit"))
    part = _unit_lines(F.col("unit"))
    unit = unit.withColumn("part", part)
    content = F.array_join(F.transform("part", lambda l: l.text), "\n")
    return unit.select(
        *keep, "section_no", _title(F.col("part")).alias("title"),
        F.element_at("part", 1).page.alias("page_start"), F.element_at("part", -1).page.alias("page_end"),
        content.alias("content"), X.text_tokens(content).alias("token_count"),
    )


def chunk_arrays(
    doc_lines: DataFrame,
    max_tokens: int = MAX_TOKENS,
    overlap_tokens: int = OVERLAP_TOKENS,
    min_tokens: int = MIN_TOKENS,
) -> DataFrame:
    """``(…, chunks)``: per document the ordered array of chunk structs."""
    planned = _plan(doc_lines, max_tokens, overlap_tokens, min_tokens)

    def chunk(title: Column, content: Column, first: Column, last: Column) -> Column:
        return F.struct(
            title.alias("clause_title"), content.alias("content"), first.alias("page_start"),
            last.alias("page_end"), X.text_tokens(content).alias("token_count"),
        )

    def whole(part: Column) -> Column:
        text = F.array_join(F.transform(part, lambda l: l.text), "\n")
        return F.array(chunk(_title(part), text, F.element_at(part, 1).page, F.element_at(part, -1).page))

    def packed(u: Column, part: Column) -> Column:
        texts = F.flatten(F.slice(F.col("pieces"), u.line + 1, u.lines))
        on_page = F.flatten(
            F.zip_with(
                part, F.slice(F.col("pieces"), u.line + 1, u.lines), lambda l, p: F.array_repeat(l.page, F.size(p))
            )
        )

        def window(w: Column) -> Column:
            body = F.array_join(F.slice(texts, w.start + 1, w.size), " ")
            title = _title(part)
            titled = F.when((w.start > 0) & title.isNotNull(), F.concat(title, F.lit("\n"), body)).otherwise(body)
            return chunk(title, titled, F.get(on_page, w.start), F.get(on_page, w.start + w.size - 1))

        return F.transform(u.windows, window)

    chunks = F.flatten(
        F.transform(
            "plan",
            lambda u: F.when(F.size(u.windows) == 0, whole(_unit_lines(u))).otherwise(packed(u, _unit_lines(u))),
        )
    )
    return planned.withColumn("chunks", chunks).drop("lines", "pieces", "plan")


def explode_chunks(chunked: DataFrame) -> DataFrame:
    """Chunk rows with a dense ``chunk_index`` from 0 and a readable ``chunk_id``."""
    row = chunked.select("doc_id", F.posexplode("chunks").alias("chunk_index", "c"))
    return row.select(
        chunk_id(F.col("doc_id"), F.col("chunk_index")).alias("chunk_id"), "doc_id", "chunk_index", "c.page_start",
        "c.page_end", "c.clause_title", "c.content", "c.token_count",
    )


def chunk_id(doc_id: Column, chunk_index: Column) -> Column:
    return F.concat(doc_id.cast("string"), F.lit(":"), F.lpad(chunk_index.cast("string"), 6, "0"))


def with_ids(chunks: DataFrame, *more: str) -> DataFrame:
    """Adds the readable ``chunk_id``, in the column order of :func:`explode_chunks`; ``more`` columns follow."""
    return chunks.select(
        chunk_id(F.col("doc_id"), F.col("chunk_index")).alias("chunk_id"), "doc_id", "chunk_index", "page_start", "page_end", "clause_title",
        "content", "token_count", *more,
    )


def chunk_documents(
    pages: DataFrame,
    max_tokens: int = MAX_TOKENS,
    overlap_tokens: int = OVERLAP_TOKENS,
    min_tokens: int = MIN_TOKENS,
) -> DataFrame:
    """Chunk documents of any length, a row a page: the chunks are planned on page numbers and no row holds a document."""
    return with_ids(segments.chunk_pages(pages, [(max_tokens, overlap_tokens)], min_tokens))


def page_sections(pages: DataFrame, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """As :func:`sections`, from a scan over the pages."""
    return segments.chunk_pages(pages, [(None, 0)], min_tokens).select(
        "doc_id", F.col("chunk_index").alias("section_no"), F.col("clause_title").alias("title"), "page_start", "page_end", "content", "token_count"
    )


def sweep_chunk_sizes(pages: DataFrame, sizes=(200, 400, 800), overlap_share: float = 0.15) -> DataFrame:
    """Chunks for every cap, tagged ``max_tokens``, from one scan over the pages."""
    caps = [(size, int(size * overlap_share + 0.5)) for size in sizes]
    return with_ids(segments.chunk_pages(pages, caps, MIN_TOKENS), "max_tokens")
