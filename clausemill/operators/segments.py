"""Sections and chunks as a scan over page numbers, so that no row or task holds a document.

Every page is reduced to its numbers: the lengths of its lines and sentences and its headings. The scan runs through a
document's pages in order and plans which lines of which page belong to which chunk, holding one chunk at a time.
The plan then meets the pages, whose texts are spread by page, and a chunk's parts meet by chunk.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions.plan import settle

#: Rows of a planned batch.
BATCH_ROWS = 10_000


def _tokens(chars: int) -> int:
    return -(-chars // 4)


@dataclass
class Unit:
    """A section, or several that were folded into one, as far as it has been read."""

    size: int = -1  # characters with a line break between lines
    titles: list[str] = field(default_factory=list)
    lines: list[list] = field(default_factory=list)  # page, first line, lines
    pieces: list[tuple[int, int, int]] = field(default_factory=list)  # page, piece of the page, cost
    later: bool = False  # windows have been handed over

    @property
    def title(self) -> str | None:
        return " > ".join(self.titles) if self.titles else None

    def head(self) -> int:
        """What the title costs in a window."""
        return _tokens(len(self.title)) + 1 if self.titles else 0


class Planner:
    """Plans the chunks of one document after the other. Without ``cap`` no section is split."""

    def __init__(self, cap: int | None, overlap: int, min_tokens: int):
        self.cap, self.overlap, self.min_tokens = cap, overlap, min_tokens
        self.start()

    def start(self) -> None:
        self.number, self.unit = 0, Unit()

    def page(self, page, sizes: Sequence[int], headings: Sequence[str | None], pieces: Sequence[Sequence[int]]) -> Iterator[tuple]:
        """Reads a page: the size of each line, its text if it is a heading, and the sizes of its sentences."""
        piece = 0
        for line, (size, heading, costs) in enumerate(zip(sizes, headings, pieces)):
            unit = self.unit
            if heading is not None and unit.size >= 0 and _tokens(unit.size) >= self.min_tokens:
                yield from self.close()
                unit = self.unit
            unit.size += size + 1
            if heading is not None:
                unit.titles.append(heading)
            if self.cap is None or _tokens(unit.size) <= self.cap:
                if unit.lines and unit.lines[-1][0] == page:
                    unit.lines[-1][2] += 1
                else:
                    unit.lines.append([page, line, 1])
            if self.cap is not None:
                for n in costs:
                    unit.pieces.append((page, piece, _tokens(n) + 1))
                    piece += 1
                if _tokens(unit.size) > max(self.cap, self.min_tokens - 1):  # no further section is folded in
                    yield from self.windows(last=False)

    def windows(self, last: bool) -> Iterator[tuple]:
        """Hands over every window that no further piece can change: as many pieces as the cap allows, at least one; the
        next window starts where the last ``overlap`` tokens of this one do, but later than this one did."""
        unit, room, at = self.unit, self.cap - self.unit.head(), 0
        while at < len(unit.pieces):
            end, held = at, 0
            while end < len(unit.pieces) and (held + unit.pieces[end][2] <= room or end == at):
                held += unit.pieces[end][2]
                end += 1
            if end == len(unit.pieces) and not last:
                break
            yield from self.chunk(unit.pieces[at:end], packed=True)
            unit.later = True
            if end == len(unit.pieces):
                break
            back, shared = end, 0
            while back > at + 1 and shared < self.overlap:
                back -= 1
                shared += unit.pieces[back][2]
            at = max(at + 1, back)
        del unit.pieces[:at]

    def chunk(self, parts: Sequence, packed: bool) -> Iterator[tuple]:
        """``(page, chunk_index, title, packed, later, start, size, page_start, page_end)`` of each part of a chunk."""
        pages: list[list] = []
        for page, start, size in parts if not packed else ((p, k, 1) for p, k, _ in parts):
            if pages and pages[-1][0] == page:
                pages[-1][2] += size
            else:
                pages.append([page, start, size])
        unit = self.unit
        for page, start, size in pages:
            yield page, self.number, unit.title, packed, unit.later, start, size, pages[0][0], pages[-1][0]
        self.number += 1

    def close(self) -> Iterator[tuple]:
        """Hands over the rest of the unit and starts the next one."""
        unit = self.unit
        if unit.size >= 0:
            if self.cap is not None and _tokens(unit.size) > self.cap:
                yield from self.windows(last=True)
            else:
                yield from self.chunk(unit.lines, packed=False)
        self.unit = Unit()


def page_lines(pages: DataFrame) -> DataFrame:
    """``doc_id``, ``page``, ``lines`` of every page; a null text has none."""
    return settle(pages.select("doc_id", "page", X.text_lines(F.coalesce("text", F.lit(""))).alias("lines")), ["lines"])


def page_numbers(pages: DataFrame) -> DataFrame:
    """``doc_id``, ``page``, ``sizes``, ``headings`` (texts of heading lines, else null), ``pieces`` (sizes of sentences)."""
    lines = F.col("lines")
    return page_lines(pages).filter(F.size("lines") > 0).select(
        "doc_id", "page", F.transform(lines, F.length).alias("sizes"), F.transform(lines, lambda t: F.when(X.is_heading(t), t)).alias("headings"),
        F.transform(lines, lambda t: F.transform(X.sentences(t), F.length)).alias("pieces"),
    )


def plan(pages: DataFrame, caps: Sequence[tuple[int | None, int]], min_tokens: int) -> DataFrame:
    """Which lines (or, where ``packed``, sentences) of which page are in which chunk, for every ``(cap, overlap)``.

    A document's page numbers run through one task in page order; that task holds one chunk of it.
    """
    key, page = pages.schema["doc_id"].dataType, pages.schema["page"].dataType
    kind = T.StructType(
        [T.StructField("doc_id", key), T.StructField("max_tokens", T.IntegerType()), T.StructField("page", page), T.StructField("chunk_index", T.IntegerType())]
        + [T.StructField("title", T.StringType()), T.StructField("packed", T.BooleanType()), T.StructField("later", T.BooleanType())]
        + [T.StructField("start", T.IntegerType()), T.StructField("size", T.IntegerType()), T.StructField("page_start", page), T.StructField("page_end", page)]
    )
    names = [f.name for f in kind.fields]

    def run(batches):
        planners = [Planner(cap, overlap, min_tokens) for cap, overlap in caps]
        document, begun, types = None, False, None

        def rows(found, planner):
            return [(document, planner.cap, *row) for row in found]

        def table(held):
            arrays = [pa.array(column, type=t) for column, t in zip(zip(*held), types)]
            return pa.RecordBatch.from_arrays(arrays, names=names)

        held = []
        for batch in batches:
            key_type, page_type = batch.schema.field("doc_id").type, batch.schema.field("page").type
            types = [key_type, pa.int32(), page_type, pa.int32(), pa.string(), pa.bool_(), pa.bool_(), pa.int32(), pa.int32(), page_type, page_type]
            for doc, number, *lines in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "page", "sizes", "headings", "pieces")]):
                if not begun or doc != document:
                    for planner in planners:
                        held += rows(planner.close(), planner)
                        planner.start()
                    document, begun = doc, True
                for planner in planners:
                    held += rows(planner.page(number, *lines), planner)
                if len(held) >= BATCH_ROWS:
                    yield table(held)
                    held = []
        for planner in planners:
            held += rows(planner.close(), planner)
        if held:
            yield table(held)

    ordered = page_numbers(pages).repartition("doc_id").sortWithinPartitions("doc_id", "page")
    return ordered.mapInArrow(run, kind)


def assemble(pages: DataFrame, planned: DataFrame) -> DataFrame:
    """The chunks of a plan with their texts: ``doc_id``, ``max_tokens``, ``chunk_index``, ``page_start``, ``page_end``,
    ``clause_title``, ``content``, ``token_count``."""
    part = F.struct("max_tokens", "chunk_index", "title", "packed", "later", "start", "size", "page_start", "page_end")
    by_page = planned.groupBy(F.col("doc_id").alias("_doc"), F.col("page").alias("_page")).agg(F.collect_list(part).alias("parts"))
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & F.col("page").eqNullSafe(F.col("_page"))
    held = page_lines(pages).join(by_page, same)
    split = F.flatten(F.transform("lines", X.sentences))
    held = held.withColumn("pieces", F.when(F.exists("parts", lambda p: p["packed"]), split).otherwise(F.array().cast("array<string>")))

    def texts(p: Column) -> Column:
        sentences = F.array_join(F.slice(F.col("pieces"), p["start"] + 1, p["size"]), " ")
        lines = F.array_join(F.slice(F.col("lines"), p["start"] + 1, p["size"]), "\n")
        return F.struct(p.alias("part"), F.when(p["packed"], sentences).otherwise(lines).alias("text"))

    rows = held.select("doc_id", "page", F.inline(F.transform("parts", texts)))
    whole = rows.groupBy("doc_id", F.col("part.max_tokens").alias("max_tokens"), F.col("part.chunk_index").alias("chunk_index")).agg(
        F.first("part").alias("part"), F.array_sort(F.collect_list(F.struct("page", "text"))).alias("texts")
    )
    texts_ = F.transform("texts", lambda t: t["text"])
    joined = F.when(F.col("part.packed"), F.array_join(texts_, " ")).otherwise(F.array_join(texts_, "\n"))
    titled = F.when(F.col("part.later") & F.col("part.title").isNotNull(), F.concat("part.title", F.lit("\n"), "body")).otherwise(F.col("body"))
    content = whole.withColumn("body", joined).withColumn("content", titled)
    return content.select(
        "doc_id", "max_tokens", "chunk_index", "part.page_start", "part.page_end", F.col("part.title").alias("clause_title"), "content",
        X.text_tokens("content").alias("token_count"),
    )


def chunk_pages(pages: DataFrame, caps: Sequence[tuple[int | None, int]], min_tokens: int) -> DataFrame:
    """The chunks of ``pages(doc_id, page, text)``, a row a page, for every ``(cap, overlap)`` from one scan."""
    return assemble(pages, plan(pages, caps, min_tokens))
