"""Personal identifiers: detection, stable placeholders, masking and unmasking.

Spans are found per page inside the JVM. Placeholders are numbered over the distinct identities of a
document; only those few rows, never the text, are sorted per document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import jsonspec as J
from ..functions import patterns as P
from ..functions.checkdigit import valid_sql
from ..session import keep

SPAN_TYPE = "array<struct<type:string,start:int,end:int,value:string>>"
NO_SPANS = f"CAST(array() AS {SPAN_TYPE})"
TYPES = P.IDENTIFIER_TYPES


#: Stands between the pieces of a searched text; a single character, so that it splits without an expression.
MARK = "\u0001"


def spans(text: str, pattern: str, kind: str, group: int = 0) -> str:
    """SQL text: all non-overlapping matches as ``struct(type, start, end, value)``, offsets from 0.

    Spark's extract-all has no offsets. One search puts ``MARK`` around every match (and its group), and the lengths of the
    pieces between marks give them, summed as the array grows. A text that holds ``MARK`` itself is cut by the pattern.
    """
    p = J.quoted(pattern)
    one = f"named_struct('type', '{kind}', 'start', a.pos + i.lead, 'end', a.pos + i.lead + length(i.value), 'value', i.value)"

    def walk(items: str) -> str:
        return (
            f"aggregate({items}, named_struct('pos', 0, 'found', {NO_SPANS}), "
            f"(a, i) -> named_struct('pos', a.pos + i.advance, 'found', concat(a.found, array({one}))), a -> a.found)"
        )

    def item(gap: str, hit: str, value: str) -> str:
        lead = f"length({gap})" + ("" if group == 0 else f" + instr({hit}, {value}) - 1")
        return f"named_struct('lead', {lead}, 'advance', length({gap}) + length({hit}), 'value', {value})"

    step = 2 if group == 0 else 3
    places = f"sequence(0, size(pieces) - 2, {step})"
    marked = walk(f"transform({places}, k -> {item('pieces[k]', 'pieces[k + 1]', f'pieces[k + {step - 1}]')})")
    # most texts with a match have one, which needs no sums
    lead, value = "length(pieces[0])" + ("" if group == 0 else " + instr(pieces[1], pieces[2]) - 1"), f"pieces[{step - 1}]"
    single = f"array(named_struct('type', '{kind}', 'start', {lead}, 'end', {lead} + length({value}), 'value', {value}))"
    found = f"CASE size(pieces) WHEN 1 THEN {NO_SPANS} WHEN {step + 1} THEN {single} ELSE {marked} END"
    around = f"{MARK}$0{MARK}" if group == 0 else f"{MARK}$0{MARK}${group}{MARK}"
    cut = J.let(f"split(regexp_replace({text}, {p}, '{around}'), '{MARK}', -1)", "pieces", f"CASE WHEN pieces IS NULL THEN {NO_SPANS} ELSE {found} END")
    values = "hits" if group == 0 else f"regexp_extract_all({text}, {p}, {group})"
    gaps = f"zip_with(slice(split({text}, {p}, -1), 1, size(hits)), hits, (g, m) -> named_struct('gap', g, 'hit', m))"
    plain = walk(f"zip_with({gaps}, {values}, (w, v) -> {item('w.gap', 'w.hit', 'v')})")
    plain = J.let(f"regexp_extract_all({text}, {p}, 0)", "hits", f"CASE WHEN size(hits) > 0 THEN {plain} ELSE {NO_SPANS} END")
    return f"CASE WHEN contains({text}, '{MARK}') THEN {plain} ELSE {cut} END"


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def identifier_candidates(text: str) -> dict[str, str]:
    """SQL text per type: the spans that also pass the type's own check."""
    digits = "regexp_replace(x.value, '[^0-9]', '')"
    before = f"substr({text}, greatest(x.start - 8, 0) + 1, x.start - greatest(x.start - 8, 0))"
    valid = J.let(digits, "n", valid_sql("n"))
    return {
        "EMAIL": spans(text, P.EMAIL_SEARCH, "EMAIL"),
        "PAN": spans(text, P.PAN, "PAN"),
        "IFSC": spans(text, P.IFSC, "IFSC"),
        "AADHAAR": f"filter({spans(text, P.AADHAAR, 'AADHAAR')}, x -> {valid})",
        "ACCOUNT": f"filter({spans(text, P.ACCOUNT, 'ACCOUNT', 1)}, x -> length({digits}) BETWEEN 9 AND 18)",
        "PHONE": f"filter({spans(text, P.PHONE, 'PHONE')}, x -> NOT ({before} RLIKE {J.quoted(P.AMOUNT_BEFORE)}))",
    }


def resolve_overlaps(candidates: str) -> str:
    """SQL text: earliest, then longest, then detector order; later spans that start inside a kept one go."""
    order = ", ".join(f"'{t}'" for t in TYPES)
    ranked = (
        f"sort_array(transform({candidates}, x -> named_struct('start', x.start, 'neg_end', -x.`end`, "
        f"'ord', array_position(array({order}), x.type), 'span', x)))"
    )
    walked = (
        f"aggregate(ranked, named_struct('cursor', -1, 'found', {NO_SPANS}), "
        "(a, x) -> CASE WHEN x.start < a.cursor THEN a ELSE "
        "named_struct('cursor', x.span.`end`, 'found', concat(a.found, array(x.span))) END, a -> a.found)"
    )
    # where no span starts inside the one before it, all stay
    apart = "forall(sequence(1, size(ranked) - 1), k -> ranked[k].start >= -ranked[k - 1].neg_end)"
    kept = f"CASE WHEN size(ranked) < 2 OR {apart} THEN ranked.span ELSE {walked} END"
    return J.let(ranked, "ranked", kept)


def detect(text: str = "text") -> Column:
    """Accepted identifier spans of one text column, in order."""
    return F.expr(resolve_overlaps(f"concat({', '.join(identifier_candidates(text).values())})"))


def identity(kind: Column, value: Column) -> Column:
    """What makes two values the same identifier."""
    digits = digits_of(value)
    return (
        F.when(kind == "EMAIL", F.lower(value))
        .when(kind.isin("PAN", "IFSC"), F.upper(value))
        .when(kind == "PHONE", F.substring(digits, F.greatest(F.length(digits) - 9, F.lit(1)), F.lit(10)))
        .otherwise(digits)
    )


def explode_spans(pages: DataFrame, keys: list[str], order: str, text: str = "text") -> DataFrame:
    """One row per accepted span: keys, order column, type, start, end, value and identity."""
    exploded = pages.select(*keys, order, F.explode(detect(text)).alias("s"))
    return exploded.select(
        *keys, order, "s.type", "s.start", "s.end", "s.value", identity(F.col("s.type"), F.col("s.value")).alias("key")
    )


def seed_placeholders(seeds: DataFrame, keys: list[str]) -> DataFrame:
    """Known placeholders ``(keys, placeholder, original)`` by identity; malformed ones are ignored and of
    two that share an identity the one with the larger ``seed_pos`` (map order) wins."""
    parsed = seeds.select(
        *keys, "seed_pos", "placeholder", "original",
        F.regexp_extract("placeholder", r"^.([^_]*)_(.*).\z", 1).alias("type"),
        F.regexp_extract("placeholder", r"^.([^_]*)_(.*).\z", 2).try_cast("bigint").alias("n"),
    ).filter(F.col("type").isin(*TYPES) & F.col("n").isNotNull())
    keyed = parsed.withColumn("key", identity(F.col("type"), F.col("original")))
    return keyed.groupBy(*keys, "type", "key").agg(
        F.max_by("placeholder", "seed_pos").alias("placeholder"),
        F.max("n").alias("n"),
        F.max_by("original", "seed_pos").alias("original"),
    )


def number_placeholders(found: DataFrame, keys: list[str], order: str, seeds: DataFrame | None = None) -> DataFrame:
    """``(keys, type, key, placeholder, original)``: numbered per type by first appearance.

    Repeats collapse map-side in the ``min``; the window then sorts distinct identities only.
    """
    first = found.groupBy(*keys, "type", "key").agg(
        F.min(F.struct(F.col(order).alias("at"), F.col("start"), F.col("value"))).alias("first")
    )
    offset = F.lit(0)
    if seeds is not None:
        known = seed_placeholders(seeds, keys)
        issued = known.groupBy(*keys, "type").agg(F.max("n").alias("issued"))
        known_ids = known.select(*keys, "type", "key")
        first = first.join(known_ids, [*keys, "type", "key"], "left_anti").join(issued, [*keys, "type"], "left")
        offset = F.coalesce(F.col("issued"), F.lit(0))
    in_order = Window.partitionBy(*keys, "type").orderBy("first.at", "first.start")
    n = (offset + F.row_number().over(in_order)).cast("string")
    fresh = first.select(
        *keys, "type", "key",
        F.concat(F.lit("["), F.col("type"), F.lit("_"), n, F.lit("]")).alias("placeholder"),
        F.col("first.value").alias("original"),
    )
    if seeds is None:
        return fresh
    return fresh.unionByName(known.select(*keys, "type", "key", "placeholder", "original"))


def splice(text: Column, replacements: Column) -> Column:
    """Replace spans ``struct(start, end, placeholder)``, sorted, by their placeholders."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(
        replacements,
        start,
        lambda s, r: F.struct(
            r.end.alias("at"),
            F.concat(s.out, F.substr(text, s.at + 1, r.start - s.at), r.placeholder).alias("out"),
        ),
        lambda s: F.concat(s.out, F.substr(text, s.at + 1)),
    )


def place(found: DataFrame, numbered: DataFrame, keys: list[str]) -> DataFrame:
    """``found`` with the ``placeholder`` of every span: spans meet their identity by equality, so that an identity with
    very many spans is a join key that adaptive execution can split."""
    return found.join(numbered.select(*keys, "type", "key", "placeholder"), [*keys, "type", "key"])


def apply_placeholders(pages: DataFrame, placed: DataFrame, keys: list[str], order: str, text: str = "text") -> DataFrame:
    """Masked ``pages``. Replacements are gathered per page, so no group outgrows one page's text, and
    pages are joined on ``(keys, order)``, so a long document spreads over many tasks."""
    placed = placed.groupBy(*keys, order).agg(
        F.array_sort(F.collect_list(F.struct("start", "end", "placeholder"))).alias("_spans")
    )
    joined = pages.join(placed, [*keys, order], "left")
    masked = F.when(F.col("_spans").isNull(), F.col(text)).otherwise(splice(F.col(text), F.col("_spans")))
    return joined.withColumn(text, masked).drop("_spans").select(*pages.columns)


def type_counts(found: DataFrame, keys: list[str]) -> DataFrame:
    """Occurrences per type, one column each."""
    kinds = ["AADHAAR", "PAN", "IFSC", "ACCOUNT", "PHONE", "EMAIL"]
    return found.groupBy(*keys).agg(*[F.count_if(F.col("type") == k).alias(k.lower()) for k in kinds])


def mask_documents(
    pages: DataFrame, keys: list[str] | None = None, order: str = "page", seeds: DataFrame | None = None, kept: bool = False
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(masked pages, placeholder table, spans)`` with one numbering per document.

    Texts are searched once: the spans, a few short values per page, are written to the shared checkpoint folder, by columns.
    So are, where they are ``kept``, placeholders and masked pages, for results that several branches read.
    """
    keys = keys or ["doc_id"]
    found = keep(explode_spans(pages, keys, order), "spans")
    placeholders = number_placeholders(found, keys, order, seeds)
    if kept:
        placeholders = keep(placeholders, "placeholders")
    masked = apply_placeholders(pages, place(found, placeholders, keys), keys, order)
    return keep(masked, "masked") if kept else masked, placeholders, found


#: A placeholder in brackets anywhere, or without them as a whole token.
_NAME = rf"(?:{'|'.join(TYPES)})_[0-9]+"
PLACEHOLDER = rf"\[{_NAME}\]|(?<![A-Z0-9_]){_NAME}(?![A-Z0-9_])"


def unmask(text: Column, entries: Column) -> Column:
    """Put originals back: ``[TYPE_n]`` everywhere, bare ``TYPE_n`` as a whole token; names without an entry stay.

    The text is cut once at all placeholders, each is looked up and the pieces are joined: what comes back is not
    searched again, and no entry costs a pass over the text.
    """

    def original(hit: Column) -> Column:
        shown = F.when(hit.startswith("["), hit).otherwise(F.concat(F.lit("["), hit, F.lit("]")))
        return F.coalesce(F.get(F.filter(entries, lambda e: e.placeholder == shown), 0).original, hit)

    def joined(hits: Column) -> Column:
        gaps = F.split(text, PLACEHOLDER, -1)
        whole = F.zip_with(gaps, F.transform(hits, original), lambda gap, name: F.concat(gap, F.coalesce(name, F.lit(""))))
        return F.when(F.size(hits) == 0, text).otherwise(F.array_join(whole, ""))

    return F.get(F.transform(F.array(F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(0))), joined), 0)


def unmask_rows(
    rows: DataFrame, pii_map: DataFrame, keys: list[str], row_keys: list[str], text: str = "text"
) -> DataFrame:
    """Unmask each row, identified by ``row_keys``, with its document's map, in map order ``seed_pos``.

    Only placeholders that occur in a row are gathered for it, so the array is bounded by the row's text.
    """
    tokens = F.array_distinct(
        F.regexp_extract_all(F.col(text), F.lit(r"(AADHAAR|PAN|IFSC|ACCOUNT|PHONE|EMAIL)_[0-9]+"), F.lit(0))
    )
    scope = list(dict.fromkeys([*keys, *row_keys]))
    wanted = rows.select(*scope, F.explode(tokens).alias("_bare"))
    bare = F.substr("placeholder", F.lit(2), F.length("placeholder") - 2)
    named = pii_map.withColumn("_bare", bare)
    entries = (
        wanted.join(named, [*keys, "_bare"])
        .groupBy(*row_keys)
        .agg(F.array_sort(F.collect_list(F.struct("seed_pos", "placeholder", "original"))).alias("_entries"))
    )
    joined = rows.join(entries, row_keys, "left")
    restored = F.when(F.col("_entries").isNull(), F.col(text)).otherwise(unmask(F.col(text), F.col("_entries")))
    return joined.withColumn(text, restored).select(*rows.columns)


def _counted(n: Column, name: Column) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), name, F.when(n > 1, "s").otherwise(""))


def map_summary(placeholders: DataFrame, keys: list[str]) -> DataFrame:
    """Summary text per document, types in the order of their first entry in the map.

    The counts are aggregated first, so at most six rows per document are gathered.
    """
    kind = F.lower(F.regexp_extract("placeholder", r"^.([^_]*)_", 1))
    counted = placeholders.groupBy(*keys, kind.alias("kind")).agg(
        F.min("seed_pos").alias("at"), F.count("*").alias("n")
    )
    piece = F.struct("at", _counted(F.col("n"), F.col("kind")).alias("text"))
    return counted.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda p: p.text), ", ").alias("summary")
    )

