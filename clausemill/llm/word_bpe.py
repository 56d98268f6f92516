"""Encoding and decoding with a word-end BPE vocabulary, frequent words by a compiled lexicon."""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausemill.session import cut_lineage

from .automaton import Lexicon, compile_lexicon

#: Words in the lexicon and bytes in one of them: the bound of what is compiled and broadcast (a few MB).
LEXICON_WORDS = 65_536
LEXICON_BYTES = 48
#: Words whose ids a worker remembers: so many of the latest, and those of the batch of as many before them.
REMEMBERED = 60_000
#: Texts that are turned into one output batch at a time, and characters after which it is handed over earlier.
BATCH_ROWS = 512
BATCH_CHARS = 4_000_000

WORD_END = "</w>"
# fixed values: the vocabulary's split into words, and Unicode's white space
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WHITE_SPACE = r"\x09-\x0d\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CHUNK = regex.compile(f"[^{WHITE_SPACE}]+")
SEPARATORS = regex.compile(r"[\x1c-\x1f]")
#: Below this character the Unicode versions of Python and of the library agree; from it on the library is asked.
COMMON = "\u0250"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where it is visible, else the next one from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, spare = {b: chr(b) for b in visible}, 256
    for byte in range(256):
        if byte not in letters:
            letters[byte] = chr(spare)
            spare += 1
    return [letters[b] for b in range(256)]


class Vocabulary:
    """The tokenizer file's ids, merges and special tokens, with exact merging of one word."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        self.ids = content["model"]["vocab"]
        pairs = (tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in content["model"]["merges"])
        self.ranks = {pair: rank for rank, pair in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in content["added_tokens"]}
        self.special_pattern = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")") if self.special else None
        self.names = {i: token for token, i in {**self.ids, **self.special}.items()}
        library = Tokenizer.from_file(path)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        self.split = regex.compile(SPLIT)
        letters = byte_letters()
        self.letters = {byte: letter for byte, letter in enumerate(letters)}

    def words(self, chunk: str) -> list[str]:
        """The words, in byte letters, of a stretch without white space."""
        if chunk.isalpha() and chunk.isascii():
            return [chunk.lower()]
        if chunk.isascii() and chunk.isprintable():
            return self.split.findall(chunk.lower())
        if max(chunk) < COMMON:
            found = self.split.findall(unicodedata.normalize("NFC", chunk).lower())
            return [w.encode().decode("latin-1").translate(self.letters) for w in found]
        return [w for w, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(chunk))]

    def merge(self, word: str) -> list[int]:
        """The word's ids: of all neighbours the pair that was learnt first is joined, until none is left."""
        parts = [*word[:-1], word[-1] + WORD_END]
        if len(parts) > 48:
            parts = self._merge_long(parts)
        rank, none = self.ranks.get, 1 << 30
        order = [rank(pair, none) for pair in zip(parts, parts[1:])]
        while order:
            first = min(order)
            if first == none:
                break
            at = order.index(first)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del order[at]
            if at:
                order[at - 1] = rank((parts[at - 1], parts[at]), none)
            if at < len(order):
                order[at] = rank((parts[at], parts[at + 1]), none)
        return [self.ids[p] for p in parts if p in self.ids]

    def _merge_long(self, parts: list[str]) -> list[str]:
        """The same with a heap of pairs over a linked list, for words where repeated passes would be quadratic."""
        after, before = [*range(1, len(parts)), -1], [-1, *range(len(parts) - 1)]
        ranks = self.ranks
        heap = [(ranks[p], i, p) for i, p in enumerate(zip(parts, parts[1:])) if p in ranks]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if j < 0 or parts[i] != pair[0] or parts[j] != pair[1]:
                continue
            parts[i], parts[j] = pair[0] + pair[1], ""
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left in (before[i], i):
                if left >= 0 and after[left] >= 0:
                    fresh = (parts[left], parts[after[left]])
                    if fresh in ranks:
                        heapq.heappush(heap, (ranks[fresh], left, fresh))
        return [p for p in parts if p]


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary at ``path``, read once per process."""
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


class Remembered:
    """Values of recent keys: two generations, of which the older goes when the newer is full."""

    def __init__(self):
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def __getitem__(self, key: str) -> bytes | None:
        value = self.new.get(key)
        if value is None:
            value = self.old.get(key)
            if value is not None:
                self.new[key] = value
        return value

    def __setitem__(self, key: str, value: bytes) -> None:
        self.new[key] = value

    def age(self) -> None:
        if len(self.new) >= REMEMBERED:
            self.old, self.new = self.new, {}


class Encoder:
    """Texts to packed ids: words by the lexicon, others by merging."""

    def __init__(self, path: str, block: bytes):
        self.vocabulary, self.lexicon = vocabulary(path), Lexicon(block)
        self.chunks, self.merged = Remembered(), Remembered()

    def word_ids(self, words: list[str]) -> dict[str, bytes]:
        out = {}
        for word, rank in zip(words, self.lexicon.ranks([w.encode() for w in words]).tolist()):
            if rank >= 0:
                out[word] = self.lexicon.packed(rank)
                continue
            value = self.merged[word]
            if value is None:
                ids = self.vocabulary.merge(word)
                value = struct.pack(f"<{len(ids)}I", *ids)
                if len(word) <= LEXICON_BYTES:
                    self.merged[word] = value
            out[word] = value
        self.merged.age()
        return out

    def plain(self, texts: list[str]) -> list[bytes]:
        """The ids of texts without special tokens; what several share is worked out once."""
        # str.split also splits at four separators that are no white space for the vocabulary
        split = [CHUNK.findall(t) if SEPARATORS.search(t) else t.split() for t in texts]
        known = {c: self.chunks[c] for c in {c for chunks in split for c in chunks}}
        missing = {c: self.vocabulary.words(c) for c, value in known.items() if value is None}
        ids = self.word_ids(list({w for words in missing.values() for w in words}))
        for chunk, words in missing.items():
            known[chunk] = value = b"".join([ids[w] for w in words])
            if len(chunk) <= LEXICON_BYTES:
                self.chunks[chunk] = value
        self.chunks.age()
        return [b"".join(map(known.__getitem__, chunks)) for chunks in split]

    def texts(self, texts: list[str | None]) -> list[bytes]:
        special = self.vocabulary.special
        parts = [
            self.vocabulary.special_pattern.split(t) if special and t is not None and "<|" in t else [t or ""] for t in texts
        ]
        plain = iter(self.plain([p for text in parts for p in text if p not in special]))
        return [b"".join([struct.pack("<I", special[p]) if p in special else next(plain) for p in text]) for text in parts]


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, block: bytes) -> Encoder:
    """The encoder of a vocabulary and a lexicon, kept by a worker from task to task; one at a time."""
    key = (path, hashlib.sha256(block).digest())
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(path, block)
    return _encoders[key]


def lexicon_words(docs: DataFrame, text: str, limit: int = LEXICON_WORDS) -> DataFrame:
    """The most frequent lower-cased stretches between white space, counted over all texts, at most ``limit``.

    Words are taken by classes of their count's logarithm as far as whole classes fit, so that no task ranks all words
    and the driver sees the sizes of a few hundred classes.
    """
    chunk = F.explode(F.split(F.lower(F.col(text)), r"\s+")).alias("word")
    counts = docs.select(chunk).filter((F.col("word") != "") & (F.octet_length("word") <= LEXICON_BYTES))
    classed = cut_lineage(
        counts.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        .select("word", F.floor(F.log2("n") * 16).alias("class"))
    )
    sizes = classed.groupBy("class").count().collect()
    lowest, room = float("inf"), limit
    for row in sorted(sizes, key=lambda r: -r["class"]):
        room -= row["count"]
        if room < 0:
            break
        lowest = row["class"]
    return classed.filter(F.col("class") >= F.lit(lowest)).select("word")


def build_lexicon(docs: DataFrame, vocabulary_path: str, text: str = "text", limit: int = LEXICON_WORDS) -> bytes:
    """The compiled lexicon of the corpus' frequent words. At most ``limit`` short words reach the driver."""
    merges = vocabulary(vocabulary_path)
    words = {w for row in lexicon_words(docs, text, limit).collect() for w in merges.words(row["word"])}
    return compile_lexicon([(w.encode(), tuple(merges.merge(w))) for w in words if w])


def _texts(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of the batches with their texts, small enough that long texts don't pile up."""
    for batch in batches:
        start = 0
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
        while start < batch.num_rows:
            end, size = start, 0
            while end < batch.num_rows and end - start < BATCH_ROWS and (end == start or size + lengths[end] <= BATCH_CHARS):
                size += lengths[end]
                end += 1
            part = batch.slice(start, end - start)
            yield part, part.column(column).to_pylist()
            start = end


def _mapped(df: DataFrame, keep: str, source: str, name: str, kind: T.DataType, arrow: pa.DataType, make) -> DataFrame:
    """``keep`` and ``name`` = the worker function of ``make()`` applied to the values of ``source``, in Arrow batches."""
    schema = T.StructType([df.schema[keep], T.StructField(name, kind)])

    def run(batches):
        work = make()
        for part, values in _texts(batches, source):
            out = pa.array(work(values), type=arrow)
            yield pa.RecordBatch.from_arrays([part.column(keep), out], names=[keep, name])

    return df.select(F.col(keep), F.col(source)).mapInArrow(run, schema)


def encode(
    docs: DataFrame, vocabulary_path: str, key: str = "doc_id", text: str = "text", lexicon: bytes | None = None
) -> DataFrame:
    """``key`` and ``ids``: each whole text's ids, packed as little-endian unsigned 32-bit integers.

    Equals the library's encoding without added special tokens; the strings of special tokens in a text become their
    ids. A null text counts as empty and has no ids. Each row is encoded by itself, without a shuffle, so keys may be
    null or repeat; an empty table gives no rows. Without a given ``lexicon`` it is compiled from all of ``docs``.
    """
    block = build_lexicon(docs, vocabulary_path, text) if lexicon is None else lexicon
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def make():
        return encoder(vocabulary_path, shared.value).texts

    return _mapped(docs, key, text, "ids", T.BinaryType(), pa.binary(), make)


def decode(encoded: DataFrame, vocabulary_path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key``, ``text``: the tokens of packed ids joined by a space, special ones included; null ids decode to ''."""

    def make():
        names = vocabulary(vocabulary_path).names

        def work(values):
            return [" ".join(filter(None, map(names.get, memoryview(v or b"").cast("I")))) for v in values]

        return work

    return _mapped(encoded, key, ids, "text", T.StringType(), pa.string(), make)


