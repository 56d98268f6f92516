"""Text columns: whitespace, headings, sentences, quotes, hashes, numbers and passage headers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import patterns as P


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), use), 0)


def strip_ws(c: Column | str) -> Column:
    return F.btrim(_col(c), F.lit(P.WS_CHARACTERS))


def collapse_ws(c: Column | str) -> Column:
    """One space for each run of whitespace, none outside; a text that has no other whitespace is only trimmed."""
    c = _col(c)
    odd = F.contains(c, F.lit("  "))
    for character in P.WS_ASCII.replace(" ", ""):
        odd = odd | F.contains(c, F.lit(character))
    plain = (F.octet_length(c) == F.length(c)) & ~odd
    return F.trim(F.when(plain, c).otherwise(F.regexp_replace(c, f"{P.WS}+", " ")))


def visible_length(c: Column | str) -> Column:
    return F.length(F.regexp_replace(_col(c), f"{P.WS}+", ""))


def text_lines(c: Column | str) -> Column:
    """Non-blank lines of a page, whitespace-collapsed, in order."""
    return F.filter(F.transform(F.split(_col(c), "\n", -1), collapse_ws), lambda s: s != "")


def token_estimate(chars: Column) -> Column:
    """About four characters per token."""
    return F.ceil(chars / F.lit(4)).cast("int")


def text_tokens(c: Column | str) -> Column:
    return token_estimate(F.length(_col(c)))


def word_count(c: Column | str) -> Column:
    return F.size(F.filter(F.split(_col(c), f"{P.WS}+", -1), lambda w: w != ""))


def is_heading(c: Column | str) -> Column:
    """Keyword, all-capitals or numbered heading; most lines fail on their length alone."""
    return F.get(F.transform(F.array(strip_ws(c)), _heading_rules), 0)


def _heading_rules(t: Column) -> Column:
    caps_words = F.filter(F.split(t, f"{P.WS}+", -1), lambda w: w.rlike(P.CAPS_WORD))
    title = F.regexp_extract(t, P.NUMBERED_HEADING, 2)
    return (
        F.when(~F.length(t).between(3, 80), False)
        .when(t.rlike(P.KEYWORD_HEADING), True)
        .when(t.rlike(P.CAPS_LINE), F.size(caps_words) >= 2)
        .when(
            t.rlike(P.NUMBERED_HEADING),
            (F.size(F.split(title, f"{P.WS}+", -1)) <= 10) & ~title.rlike(r"[.;]\z"),
        )
        .otherwise(False)
    )


def sentences(c: Column | str) -> Column:
    """Sentence pieces of one line, trimmed, without empties."""
    return F.filter(F.transform(F.split(_col(c), P.SENTENCE_BOUNDARY, -1), strip_ws), lambda s: s != "")


def pattern_hits(c: Column, pattern: str) -> Column:
    """How often a pattern occurs; texts without any of its literal openings skip the regex."""
    count = F.regexp_count(c, F.lit(P.ascii_edges(pattern)))
    openings = P.literal_openings(pattern)
    if not openings:
        return count
    possible = F.contains(c, F.lit(openings[0]))
    for word in openings[1:]:
        possible = possible | F.contains(c, F.lit(word))
    return F.when(possible, count).otherwise(0)


def quote(c: Column | str, limit: int = 220) -> Column:
    """First sentence of the text below its first line, at most ``limit`` characters."""
    c = _col(c)
    body = F.when(F.instr(c, "\n") > 0, F.substr(c, F.instr(c, "\n") + 1)).otherwise(c)

    def sentence(body: Column) -> Column:
        first = F.regexp_extract(body, r"^([^\n\r\u2028\u2029]{20,}?)" + P.SENTENCE_BOUNDARY, 1)
        return _once(first, lambda f: strip_ws(F.when(f != "", f).otherwise(body)))

    def shown(s: Column) -> Column:
        return F.when(F.length(s) > limit, F.concat(F.substr(s, F.lit(1), F.lit(limit - 1)), F.lit("…"))).otherwise(s)

    return _once(_once(body, sentence), shown)


def normalise_question(c: Column | str) -> Column:
    kept = F.regexp_replace(F.lower(_col(c)), r"[^\p{L}\p{N}" + P.WS[1:-1] + r"\[\]_]", " ")
    return collapse_ws(kept)


def embedding_key(model: Column, dims: Column, task: Column, text: Column) -> Column:
    return F.sha2(F.concat_ws(":", model, dims.cast("string"), task, text), 256)


def answer_key(doc_id: Column, model: Column, question: Column, history_size: Column) -> Column:
    """Cache key of a standalone question; follow-ups have none."""
    key = F.concat_ws("|", doc_id.cast("string"), model, normalise_question(question))
    return F.when(history_size == 0, F.sha2(key, 256))


def fingerprint(ordered_pages: Column) -> Column:
    """SHA-256 of page texts joined by form feeds."""
    return F.sha2(F.array_join(ordered_pages, chr(12)), 256)


def numbers_in(c: Column | str) -> Column:
    found = F.regexp_extract_all(_col(c), F.lit(P.NUMBER_IN_TEXT), F.lit(1))
    return F.transform(found, lambda s: F.regexp_replace(s, ",", "").cast("double"))


def passage_header(
    number: Column, page_start: Column, page_end: Column, title: Column, label: str = "clause", ranged: bool = True
) -> Column:
    """``[n] (page p | clause: t)``; the outline variant shows the first page only."""
    single = F.concat(F.lit("page "), page_start.cast("string"))
    pages = single
    if ranged:
        several = F.concat(F.lit("pages "), page_start.cast("string"), F.lit("-"), page_end.cast("string"))
        pages = F.when(page_start == page_end, single).otherwise(several)
    clause = F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit(f" | {label}: "), title)).otherwise(F.lit(""))
    return F.concat(F.lit("["), number.cast("string"), F.lit("] ("), pages, clause, F.lit(")"))


def passage(number, page_start, page_end, title, content, label: str = "clause", ranged: bool = True) -> Column:
    return F.concat(passage_header(number, page_start, page_end, title, label, ranged), F.lit("\n"), content)


#: The bytes of search tokens, all others stand between them; bytes of text that are cut at a time.
_TOKEN_BYTES = np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyz0123456789%"))
_CUT_BYTES = 4 << 20


def search_tokens(c: Column | str) -> Column:
    """Lower-case tokens without placeholders, stop words and one-character pieces, one suffix removed.

    Texts are cut as bytes, whole batches at once; stop words and suffixes are looked at once per distinct token of a batch.
    """
    return F.arrow_udf(cut_tokens, T.ArrayType(T.StringType()))(_lowered(c))


def _lowered(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(_col(c)), P.PLACEHOLDER_TOKEN, " ")


def cut_tokens(texts: pa.Array) -> pa.Array:
    """The tokens of lowered texts; a null text has none, not even an empty list."""
    return _cut(texts, 0)


def cut_lexemes(texts: pa.Array) -> pa.Array:
    return _cut(texts, 1)


def _cut(texts: pa.Array, least: int) -> pa.Array:
    lost, texts = texts.is_null(), texts.cast(pa.string()).fill_null("")
    ends = np.cumsum(pa.compute.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    parts, begin = [], 0
    while begin < len(texts):
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + _CUT_BYTES, side="right")))
        parts.append(_token_lists(texts.slice(begin, end - begin), least))
        begin = end
    if not parts:
        return pa.array([], pa.list_(pa.string()))
    sizes = np.concatenate([size for size, _ in parts])
    offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.concat_arrays([words for _, words in parts]), mask=lost)


def _token_lists(texts: pa.Array, least: int) -> tuple[np.ndarray, pa.Array]:
    """How many tokens each text has, and the tokens of all of them."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    first, last = int(offsets[0]), int(offsets[-1])
    if first == last:
        return np.zeros(len(texts), np.int64), pa.array([], pa.string())
    data = np.frombuffer(texts.buffers()[2], np.uint8)[first:last]
    starts = (offsets[:-1] - first)[np.diff(offsets) > 0]
    inside = _TOKEN_BYTES[data]
    opens, shuts = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    opens[starts] = inside[starts]
    shuts[:-1] &= ~inside[1:]
    shuts[starts[1:] - 1] = inside[starts[1:] - 1]
    opens, shuts = np.flatnonzero(opens), np.flatnonzero(shuts)
    bounds = np.concatenate(([0], np.cumsum(shuts - opens + 1))).astype(np.int32)
    raw = pa.StringArray.from_buffers(len(opens), pa.py_buffer(bounds), pa.py_buffer(data[inside])).dictionary_encode()
    words = raw.dictionary.to_pylist()
    cut = [_without_suffix(w) for w in words]
    kept = np.array([len(w) > 1 and w not in _STOP_WORDS and len(c) >= least for w, c in zip(words, cut)], bool)
    index = raw.indices.to_numpy(zero_copy_only=False)
    stays = kept[index] if len(index) else np.zeros(0, bool)
    tokens = pa.array(cut, pa.string()).take(pa.array(index[stays]))
    before = np.concatenate(([0], np.cumsum(stays)))
    return np.diff(before[np.searchsorted(opens, offsets - first)]), tokens


_STOP_WORDS = frozenset(P.STOP_WORDS)


def _without_suffix(t: str) -> str:
    """The longest suffix goes."""
    for suffix in P.SUFFIXES:
        if t.endswith(suffix):
            return t[: len(t) - len(suffix)]
    return t


def lexemes(c: Column | str) -> Column:
    """The search tokens that are more than a suffix."""
    return F.arrow_udf(cut_lexemes, T.ArrayType(T.StringType()))(_lowered(c))


def source_type(mime: Column, file_name: Column) -> Column:
    """``pdf`` or ``docx`` by mime type or extension; null is an unsupported upload."""
    extension = F.element_at(F.split(F.lower(file_name), r"\.", -1), -1)
    docx_mime = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
    return F.when((mime == "application/pdf") | (extension == "pdf"), "pdf").when(
        (mime == docx_mime) | (extension == "docx"), "docx"
    )


def title_from_file_name(c: Column | str) -> Column:
    base = F.regexp_replace(_col(c), r"\.[^.]+\z", "")
    base = strip_ws(F.regexp_replace(base, "[_-]+", " "))
    return F.coalesce(F.nullif(F.substring(base, 1, 120), F.lit("")), F.lit("Untitled document"))


def normalise_raw_text(c: Column | str) -> Column:
    """Line ends to LF, at most one blank line in a row, outer whitespace removed."""
    unix = F.regexp_replace(_col(c), "\r\n", "\n")
    return strip_ws(F.regexp_replace(unix, "\n{3,}", "\n\n"))


def highlight_form(c: Column) -> Column:
    """Text as highlighting compares it, ignoring case and spacing: made once per text, before texts meet."""
    return F.lower(collapse_ws(c))


def highlight_hit(run: Column, chunk_text: Column) -> Column:
    """A run of at least 12 characters that occurs in the cited chunk; both in :func:`highlight_form`."""
    return (F.length(run) >= 12) & F.contains(chunk_text, run)
