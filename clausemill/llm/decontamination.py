"""Benchmark passages in training texts by spaced-seed hashing."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tokens that must be compared, or all of a shorter passage; of them the share below may differ.
WINDOW = 13
#: A passage with fewer tokens is not told from chance and never found.
SHORTEST = 8
DIFFERENT_PERCENT = 20
#: Token places that each mask compares. Whatever places of 8 to 13 tokens differ, up to the share above, at least one
#: mask fits beside them (the tests try all).
MASKS = ((0, 1, 2, 3, 4), (0, 1, 2, 4, 5), (0, 1, 3, 6, 7))
#: Benchmark tokens in one broadcast (about 100 bytes each with their seeds); a larger benchmark takes several.
BLOCK_TOKENS = 1 << 20
BITS = 24
#: Characters whose tokens are looked up together.
BATCH_CHARS = 4_000_000
REMEMBERED = 300_000
WORD = re.compile(r"\w+")

LEAKS = "array<struct<item_id:long, doc_start:long, item_start:long, compared:int, equal:int>>"


class Tokens:
    """Texts to 64-bit token hashes; a worker remembers the hashes of frequent words."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def __call__(self, text: str | None) -> list[int]:
        known, out = self.known, []
        if len(known) > REMEMBERED:
            known.clear()
        for word in WORD.findall((text or "").lower()):
            value = known.get(word)
            if value is None:
                value = known[word] = xxhash.xxh64_intdigest(word)
            out.append(value)
        return out


def seeds(tokens: np.ndarray, mask: int) -> np.ndarray:
    """The hash of the masked tokens that start at each place; empty if the mask is longer than the tokens."""
    places = MASKS[mask]
    count = max(0, len(tokens) - places[-1])
    mixed = np.full(count, mask + 1, np.uint64)
    for place in places:
        mixed = (mixed ^ tokens[place : place + count]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
    return mixed


def needed(window: int) -> int:
    return window - window * DIFFERENT_PERCENT // 100


@dataclass
class Index:
    """The passages of one block with their seeds in sorted order."""

    items: np.ndarray
    starts: np.ndarray
    tokens: np.ndarray
    hashes: np.ndarray
    owners: np.ndarray
    places: np.ndarray
    bits: np.ndarray

    @staticmethod
    def build(passages: list[tuple[int | None, list[int]]]) -> Index:
        passages = [(i, t) for i, t in passages if len(t) >= SHORTEST]
        lists = [np.array(t, np.uint64) for _, t in passages]
        starts = np.cumsum([0, *(len(t) for t in lists)])
        found = [(owner, seeds(t, m)) for owner, t in enumerate(lists) for m in range(len(MASKS))]
        hashes = np.concatenate([h for _, h in found] or [np.zeros(0, np.uint64)])
        owners = np.concatenate([np.full(len(h), o) for o, h in found] or [np.zeros(0, int)]).astype(np.int64)
        places = np.concatenate([np.arange(len(h)) for _, h in found] or [np.zeros(0, int)]).astype(np.int64)
        order = np.argsort(hashes, kind="stable")
        bits = np.zeros(1 << BITS - 3, np.uint8)
        for at in Index._bits(hashes):
            np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        tokens = np.concatenate(lists or [np.zeros(0, np.uint64)])
        return Index(np.array([i for i, _ in passages], object), starts, tokens, hashes[order], owners[order], places[order], bits)

    @staticmethod
    def _bits(hashes: np.ndarray) -> list[np.ndarray]:
        return [(hashes >> np.uint64(64 - BITS)).astype(np.int64), (hashes & np.uint64((1 << BITS) - 1)).astype(np.int64)]

    def hits(self, tokens: np.ndarray) -> np.ndarray:
        """Rows (text place, passage, passage place) where a seed of the text is one of a passage."""
        out = []
        for mask in range(len(MASKS)):
            mixed = seeds(tokens, mask)
            at = np.arange(len(mixed))
            for choose in range(2):  # two bits per seed keep most places from the search below
                bit = self._bits(mixed[at])[choose]
                at = at[(self.bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1]
            low = np.searchsorted(self.hashes, mixed[at], "left")
            many = np.searchsorted(self.hashes, mixed[at], "right") - low
            each = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            out.append(np.stack([np.repeat(at, many), self.owners[each], self.places[each]], axis=1))
        return np.concatenate(out)

    def leaks(self, tokens: np.ndarray, ends: np.ndarray) -> list[list[tuple]]:
        """Per text (``tokens`` holds several, up to ``ends``) the passages in it, each at its best aligned window."""
        found: list[list[tuple]] = [[] for _ in ends]
        hits = self.hits(tokens)
        if not len(hits):
            return found
        text = np.searchsorted(ends, hits[:, 0], "right")
        begin = np.concatenate(([0], ends[:-1]))
        lines = np.unique(np.stack([text, hits[:, 1], hits[:, 0] - hits[:, 2]], axis=1), axis=0)
        best: dict[tuple[int, int], tuple] = {}
        for which, owner, shift in lines.tolist():
            passage = self.tokens[self.starts[owner] : self.starts[owner + 1]]
            first, last = max(0, int(begin[which]) - shift), min(len(passage), int(ends[which]) - shift)
            window = min(WINDOW, len(passage))
            if last - first < window:
                continue
            equal = tokens[first + shift : last + shift] == passage[first:last]
            total = np.concatenate(([0], np.cumsum(equal)))
            sums = total[window:] - total[:-window]
            most = int(sums.max())
            if most >= needed(window):
                at = first + int(sums.argmax())
                leak = (self.items[owner], at + shift - int(begin[which]), at, window, most)
                old = best.get((which, owner))
                if old is None or (-most, leak[1]) < (-old[4], old[1]):
                    best[which, owner] = leak
        for (which, _), leak in best.items():
            found[which].append(leak)
        return [sorted(x, key=lambda leak: (leak[0] is None, leak[0] or 0, leak[1:])) for x in found]


def _batches(texts: pd.Series) -> Iterator[list]:
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text or "")
        if size >= BATCH_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def _blocks(benchmark: DataFrame, item: str, text: str, block_tokens: int) -> Iterator[Index]:
    """Indexes over all passages, each of at most ``block_tokens`` tokens or of one longer passage.

    The passages come to the driver one partition at a time; what is kept at once is one block.
    """
    tokenize, part, size = Tokens(), [], 0
    passages = benchmark.select(F.col(item).try_cast("long").alias("i"), F.col(text).alias("t"))
    for row in passages.distinct().toLocalIterator():
        tokens = tokenize(row["t"])
        if part and size + len(tokens) > block_tokens:
            yield Index.build(part)
            part, size = [], 0
        part.append((row["i"], tokens))
        size += len(tokens)
    if part:
        yield Index.build(part)


def _finder(shared):
    @F.pandas_udf(LEAKS)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenize, held = Tokens(), shared.value
        for texts in batches:
            out = []
            for part in _batches(texts):
                lists = [tokenize(t) for t in part]
                ends = np.cumsum([len(x) for x in lists])
                tokens = np.fromiter((v for x in lists for v in x), np.uint64, int(ends[-1]))
                out.extend(held.leaks(tokens, ends))
            yield pd.Series([[dict(zip(("item_id", "doc_start", "item_start", "compared", "equal"), x)) for x in row] for row in out])

    return find


def leaks(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
    block_tokens: int = BLOCK_TOKENS,
) -> Column:
    """A column for rows of ``docs``: the passages found in the whole text, one entry per passage, as ``LEAKS``.

    Tokens are lower-cased words. A passage is in a text if, aligned without gaps, some window of ``WINDOW`` of its
    tokens (all, if it has fewer) has at most ``DIFFERENT_PERCENT`` % other tokens there; of several places the one with most
    equal tokens counts, then the first. The benchmark's seeds are broadcast in blocks of a checked size, so texts are
    neither shuffled nor gathered and a passage in very many texts is no skew. Null and empty texts and passages of
    fewer than ``SHORTEST`` tokens give nothing; a repeated passage id counts with each of its texts, and a
    passage whose id is null or no number is found with a null id; an empty benchmark finds nothing.
    """
    columns = []
    for index in _blocks(benchmark, item, item_text, block_tokens):
        columns.append(_finder(docs.sparkSession.sparkContext.broadcast(index))(F.col(text)))
    return F.concat(*columns) if columns else F.array().cast(LEAKS)


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """A row per text and passage found in it: ``key`` and the fields of ``LEAKS``. Rows are independent, keys may repeat."""
    found = docs.select(F.col(key), leaks(docs, benchmark, text, **more).alias("leak"))
    return found.select(key, F.inline("leak"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", **more) -> DataFrame:
    """The rows of ``docs`` without a benchmark passage, with all their columns."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text}`").alias("body"))
    judged = packed.withColumn("leak", leaks(packed, benchmark, "body", **more))
    return judged.filter(F.size("leak") == 0).select("row.*")
