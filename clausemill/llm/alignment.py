"""How two tokenizers cut the same bytes: groups between common ends, links of overlapping tokens, their corpus counts.

Texts are cut where a space follows other than white space. No entry of either vocabulary reaches over such a place
(:class:`Pair` verifies it), so both tokenizers cut there too and what is between two cuts is aligned once per worker.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausemill.session import cut_lineage

from .perfect_hash import PerfectHash
from .word_bpe import COMMON, byte_letters

SPACE = "▁"
# fixed value: how the byte-level vocabulary cuts a text before merging
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")
#: Where a cut is not simply every space: white space in front of a space.
ODD = re.compile(r"\s ")
CUT = re.compile(r"(?<=\S)(?= )")
#: Short pieces of visible ASCII.
PLAIN = re.compile(r"[!-~]{1,200}\Z").match

#: Pieces that a worker remembers, the characters of the longest of them, characters that are encoded at a time.
REMEMBERED, LONGEST, STRETCH = 700_000, 200, 200_000
#: Texts and characters of a batch.
BATCH_ROWS, BATCH_CHARS = 512, 2_000_000
#: Distinct pairs that a worker counts before it hands them over.
COUNTED = 2_000_000
#: Pairs with one hash function, and pairs whose counts are broadcast at a time (17 bytes each).
SHARD_PAIRS, BLOCK_PAIRS = 1 << 17, 1 << 22
#: Vectors that are added up by one task.
FAN_IN = 16

_BITS = 16  # of the second id in a pair
_PAIR = (1 << (2 * _BITS)) - 1


class Pair:
    """Both tokenizers with the bytes of their entries."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        with open(path_a, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        byte_of = {letter: byte for byte, letter in enumerate(byte_letters())}
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for entry, number in vocabulary.items():
            self.bytes_a[number] = bytes(byte_of[c] for c in entry) if all(c in byte_of for c in entry) else entry.encode()
        self.quick = self._quick(vocabulary, path_a)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(m[1], 16)]) if (m := BYTE_PIECE.fullmatch(p)) else p.replace(SPACE, " ").encode() for p in pieces]
        self.sizes_a, self.sizes_b = (np.array([len(b) for b in x], np.int64) for x in (self.bytes_a, self.bytes_b))
        #: Whether texts may be cut in front of spaces.
        self.separable = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces)
        most = max(len(self.bytes_a), len(self.bytes_b))
        if len(self.bytes_b) > 1 << _BITS:
            raise ValueError(f"the second vocabulary has more than {1 << _BITS} entries")
        # an id in decimal with what follows it: the next id, the other tokenizer's ids, the next group
        self.shown = [str(n).encode() + sep for n in range(most) for sep in (b",", b"|", b";")]

    def _quick(self, vocabulary: dict[str, int], path: str):
        """A faster encoder with the same ids where ids are in the order of merges, as its ranks must be; else None."""
        import tiktoken

        with open(path, encoding="utf-8") as file:
            merges = json.load(file)["model"]["merges"]
        joined = [m.replace(" ", "") if isinstance(m, str) else "".join(m) for m in merges]
        if any(vocabulary[entry] != 256 + n for n, entry in enumerate(joined)):
            return None
        ranks = {self.bytes_a[number]: number for number in range(256 + len(joined))}
        return tiktoken.Encoding("quick", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})

    def encode(self, spaced: str, quick: bool = False) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids of a text with its leading space, or None where either tokenizer's bytes are not the text's.

        With ``quick`` the text is of short words; above ``COMMON`` the libraries' Unicode versions may differ.
        """
        quick = quick and self.quick is not None and max(spaced) < COMMON
        ids_a = self.quick.encode_ordinary(spaced) if quick else self.a.encode(spaced, add_special_tokens=False).ids
        ids_b, body = self.b.encode(spaced[1:]), spaced.encode()
        if b"".join(map(self.bytes_a.__getitem__, ids_a)) != body or b"".join(map(self.bytes_b.__getitem__, ids_b)) != body:
            return None
        return np.array(ids_a, np.int64), np.array(ids_b, np.int64)


def distinct(ordered: np.ndarray) -> np.ndarray:
    """The values of a sorted array, once each."""
    return ordered[np.concatenate(([True], ordered[1:] != ordered[:-1]))] if len(ordered) else ordered


class Aligned:
    """The tokens of a text with their groups and links, as arrays over the whole text."""

    def __init__(self, pair: Pair, ids_a: np.ndarray, ids_b: np.ndarray):
        self.pair = pair
        self.ends_a, self.ends_b = np.cumsum(pair.sizes_a[ids_a]), np.cumsum(pair.sizes_b[ids_b])
        place = np.searchsorted(self.ends_b, self.ends_a)
        self.common = self.ends_a[self.ends_b[place] == self.ends_a]  # both end with the text
        self.ends = np.concatenate([self.ends_a, self.ends_b])
        self.ends.sort(kind="stable")
        self.ends = distinct(self.ends)
        # between two neighbouring ends one token of either side is open: that is one overlapping pair
        self.links = (ids_a[np.searchsorted(self.ends_a, self.ends)] << _BITS) | ids_b[np.searchsorted(self.ends_b, self.ends)]
        group_a, group_b = np.searchsorted(self.common, self.ends_a), np.searchsorted(self.common, self.ends_b)
        begins = np.concatenate(([0], self.common))
        place_a = np.arange(len(ids_a)) + np.searchsorted(self.ends_b, begins[group_a], side="right")
        place_b = np.arange(len(ids_b)) + np.searchsorted(self.ends_a, self.common[group_b], side="right")
        self.codes = np.empty(len(ids_a) + len(ids_b), np.int64)
        self.codes[place_a] = 3 * ids_a + (self.common[group_a] == self.ends_a)
        self.codes[place_b] = 3 * ids_b + 2 * (self.common[group_b] == self.ends_b)

    def stops(self, ends: np.ndarray) -> np.ndarray:
        """How many tokens of a, of b, groups and links there are up to each of the bytes ``ends``, a row for each."""
        return np.stack([np.searchsorted(x, ends, side="right") for x in (self.ends_a, self.ends_b, self.common, self.ends)], axis=1)

    def texts(self, stops: np.ndarray) -> list[bytes]:
        """The groups of the parts that end at ``stops``, as text."""
        shown, codes = self.pair.shown, self.codes.tolist()
        ends = (stops[:, 0] + stops[:, 1]).tolist()
        return [b"".join([shown[c] for c in codes[start:end]])[:-1] for start, end in zip([0, *ends], ends)]


def pieces(text: str, separable: bool) -> list[str]:
    """What stands between the spaces where both tokenizers cut; every piece had one space in front."""
    if not separable or SPACE in text:
        return [text]
    if ODD.search(text) or text[:1] == " ":
        found = [p[1:] for p in CUT.split(" " + text)]
    else:
        found = text.split(" ")
    if len(found) > 1 and not found[-1].strip():  # white space at the end belongs to what is before it
        found[-2:] = [found[-2] + " " + found[-1]]
    return found


class Worker:
    """Pieces of texts to numbers that are worked out once; ``known`` has a piece's row, None where it is not given back.

    :meth:`add` takes what is asked of new pieces; their rows of ``sizes`` (tokens of a, of b, groups, links) are kept here.
    """

    def __init__(self, pair: Pair):
        self.pair = pair
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int | None] = {}
        self.sizes = np.zeros((0, 4), np.int64)
        self.fresh: list[np.ndarray] = []
        self.count = 0

    def add(self, aligned: Aligned, stops: np.ndarray) -> None:
        raise NotImplementedError

    def _take(self, found: list[str], aligned: Aligned, ends: np.ndarray) -> None:
        stops = aligned.stops(ends)
        self.known.update(zip(found, range(self.count, self.count + len(found))))
        self.count += len(found)
        self.fresh.append(np.diff(stops, axis=0, prepend=0))
        self.add(aligned, stops)

    def _alone(self, piece: str) -> None:
        ids = self.pair.encode(" " + piece)
        if ids is None:
            self.known[piece] = None
        else:
            self._take([piece], Aligned(self.pair, *ids), np.array([len(piece.encode()) + 1]))

    def _together(self, found: list[str]) -> None:
        """Pieces as one text; one by one where its bytes or its cuts are not theirs."""
        ids = self.pair.encode(" " + " ".join(found), quick=True) if found else None
        if ids is not None:
            aligned = Aligned(self.pair, *ids)
            ends = np.cumsum([(len(p) if p.isascii() else len(p.encode())) + 1 for p in found])
            if (aligned.common[np.searchsorted(aligned.common, ends)] == ends).all():
                self._take(found, aligned, ends)
                return
        for piece in found:
            self._alone(piece)

    def learn(self, wanted: set[str]) -> None:
        """Pieces are learnt together, printable ASCII, other common and rare characters apart."""
        plain = [p for p in wanted if PLAIN(p)]
        groups: dict[bool, list[str]] = {False: [], True: []}
        for piece in wanted.difference(plain) if len(plain) < len(wanted) else ():
            if not piece or len(piece) > LONGEST or piece[-1].isspace() or SPACE in piece:
                self._alone(piece)
            else:
                groups[max(piece) >= COMMON].append(piece)
        for found in (plain, *groups.values()):
            at = 0
            while at < len(found):
                end, size = at, 0
                while end < len(found) and size < STRETCH:
                    size += len(found[end]) + 1
                    end += 1
                self._together(found[at:end])
                at = end
        if self.fresh:
            self.sizes = np.concatenate([self.sizes, *self.fresh])
            self.fresh = []

    def rows(self, texts: list[str | None]) -> list[list[int] | None]:
        """The rows of each text's pieces; None for a text without tokens."""
        if self.count > REMEMBERED:
            self.clear()
        split = [pieces(t, self.pair.separable) if t else None for t in texts]
        wanted: set[str] = set()
        wanted.update(*filter(None, split))
        fresh = wanted.difference(self.known)
        self.learn(fresh)
        row = self.known.__getitem__
        out = [None if found is None else list(map(row, found)) for found in split]
        for piece in [p for p in fresh if len(p) > LONGEST]:
            del self.known[piece]
        return [None if found is None or None in found else found for found in out]


class Linked(Worker):
    """Keeps the links of every piece, one piece after the other."""

    def clear(self) -> None:
        super().clear()
        self.links = np.zeros(0, np.int64)
        self.new: list[np.ndarray] = []

    def add(self, aligned: Aligned, stops: np.ndarray) -> None:
        self.new.append(aligned.links)

    def pairs(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The distinct pairs that the texts hold linked, and how many of the texts hold each."""
        rows = [found for found in self.rows(texts) if found]
        if self.new:
            self.links, self.new = np.concatenate([self.links, *self.new]), []
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        held = np.concatenate([np.array(found, np.int64) for found in rows])
        held |= np.repeat(np.arange(len(rows)), [len(found) for found in rows]) << (2 * _BITS)
        held.sort()
        held = distinct(held)
        text, row = held >> (2 * _BITS), held & _PAIR
        sizes = self.sizes[:, 3]
        starts, many = (np.cumsum(sizes) - sizes)[row], sizes[row]
        at = np.arange(many.sum()) + np.repeat(starts - (np.cumsum(many) - many), many)
        held = (np.repeat(text, many) << (2 * _BITS)) | self.links[at]
        held.sort()
        pairs = distinct(held) & _PAIR
        pairs.sort()
        first = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1])))
        return pairs[first], np.diff(np.append(first, len(pairs)))


class Counted(Worker):
    """Keeps the groups of every piece as text, and the sums of its links' counts."""

    def __init__(self, pair: Pair, counts: Counts, groups: bool):
        self.counts, self.groups = counts, groups
        super().__init__(pair)

    def clear(self) -> None:
        super().clear()
        self.texts: list[bytes] = []
        self.sums = np.zeros((0, 2), np.int64)
        self.new: list[np.ndarray] = []

    def add(self, aligned: Aligned, stops: np.ndarray) -> None:
        n, highest = self.counts(aligned.links)
        running = np.cumsum(np.stack([highest.astype(np.int64), n], axis=1), axis=0)
        self.new.append(np.diff(running[stops[:, 3] - 1], axis=0, prepend=0))
        if self.groups:
            self.texts += aligned.texts(stops)

    def numbers(self, texts: list[str | None]) -> list[tuple]:
        """The six numbers and the groups of every text."""
        rows = self.rows(texts)
        if self.new:
            self.sums, self.new = np.concatenate([self.sums, *self.new]), []
        held = [found for found in rows if found]
        totals = iter(())
        if held:
            flat = np.concatenate([np.array(found, np.int64) for found in held])
            starts = np.cumsum([0, *(len(found) for found in held[:-1])])
            totals = iter(np.concatenate([np.add.reduceat(x[flat], starts, axis=0) for x in (self.sizes, self.sums)], axis=1).tolist())
        out = []
        for found in rows:
            shown = b";".join([self.texts[r] for r in found]).decode() if found and self.groups else "" if self.groups else None
            out.append((*next(totals), shown) if found else (0, 0, 0, 0, 0, 0, ""))
        return out


_workers: dict[tuple, Worker] = {}


def worker_of(key: tuple, make) -> Worker:
    """The worker of ``key``, kept from task to task; one at a time."""
    if key not in _workers:
        _workers.clear()
        _workers[key] = make()
    return _workers[key]


_pairs: dict[tuple[str, str], Pair] = {}


def pair_of(path_a: str, path_b: str) -> Pair:
    key = (path_a, path_b)
    if key not in _pairs:
        _pairs[key] = Pair(*key)
    return _pairs[key]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Parts of the batches with their texts, so small that long texts do not pile up."""
    for batch in batches:
        texts, start, size = batch.column("text").to_pylist(), 0, 0
        for n, text in enumerate(texts):
            size += len(text or "")
            if size >= BATCH_CHARS or n + 1 - start >= BATCH_ROWS or n + 1 == len(texts):
                yield batch.slice(start, n + 1 - start), texts[start : n + 1]
                start, size = n + 1, 0


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    out = np.zeros(len(distinct), np.int64)
    np.add.at(out, at, np.concatenate(counts))
    return distinct, out


def pair_counts(docs: DataFrame, path_a: str, path_b: str, text: str = "text") -> DataFrame:
    """``pair`` (the first id times 65,536 plus the second), ``n``: texts that hold the pair linked, as counted by one worker.

    A worker hands a pair over once, or several times where it meets more than ``COUNTED`` pairs.
    """

    def run(batches):
        worker = worker_of((path_a, path_b), lambda: Linked(pair_of(path_a, path_b)))
        keys, counts, held = [], [], 0

        def out():
            distinct, n = _summed(keys, counts)
            yield pa.RecordBatch.from_arrays([pa.array(distinct), pa.array(n)], names=["pair", "n"])

        for _, texts in _slices(batches):
            distinct, n = worker.pairs(texts)
            if len(distinct):
                keys.append(distinct)
                counts.append(n)
                held += len(distinct)
            if held > COUNTED:
                distinct, n = _summed(keys, counts)
                keys, counts, held = [distinct], [n], len(distinct)
                if 2 * held > COUNTED:
                    yield from out()
                    keys, counts, held = [], [], 0
        if keys:
            yield from out()

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "pair long, n long")


def _shard(shards: int) -> Column:
    """All pairs of a first id are in one shard."""
    return F.pmod(F.shiftright("pair", _BITS), F.lit(shards)).cast("int")


def hashed_counts(counted: DataFrame) -> tuple[DataFrame, int, int]:
    """``shard``, ``levels``, ``pairs``, ``counts``: of every shard its perfect hash and the vector of its pairs' counts.

    The distinct pairs of a shard are hashed first. Then the workers' counts are put into dense vectors, at the number
    that the hash gives their pair, and the vectors are added up in a tree of ``FAN_IN`` branches, so that no task holds
    more than a shard's vectors however often a pair was counted. Also returned: the number of shards and of pairs.
    """
    counted = cut_lineage(counted)
    distinct = cut_lineage(counted.select("pair").distinct())
    size = distinct.count()
    shards = max(1, -(-size // SHARD_PAIRS))

    def build(table: pa.Table) -> pa.Table:
        made = PerfectHash.build(table["pair"].to_numpy())
        return pa.table(
            {
                "shard": pa.array([table["shard"][0].as_py()], pa.int32()), "levels": pa.array([[x.tobytes() for x in made.levels]], pa.list_(pa.binary())),
                "pairs": pa.array([made.keys.tobytes()], pa.binary()),
            }
        )

    hashes = cut_lineage(
        distinct.withColumn("shard", _shard(shards)).groupBy("shard").applyInArrow(build, "shard int, levels array<binary>, pairs binary")
    )
    leaves = max(1, -(-_tasks(counted) // FAN_IN))

    def leaf(counts: pa.Table, hashed: pa.Table) -> pa.Table:
        hash_ = read_hash(hashed["levels"][0].as_py(), hashed["pairs"][0].as_py())
        vector = np.zeros(len(hash_.keys), np.int64)
        if counts.num_rows:
            np.add.at(vector, hash_(counts["pair"].to_numpy()), counts["n"].to_numpy())
        return _vector(hashed["shard"][0].as_py(), hashed["leaf"][0].as_py(), vector)

    def add(vectors: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v, np.int64) for v in vectors["counts"].to_pylist())
        return _vector(vectors["shard"][0].as_py(), vectors["leaf"][0].as_py(), total)

    kind = "shard int, leaf int, counts binary"
    dealt = counted.select("pair", "n", _shard(shards).alias("shard"), F.pmod(F.spark_partition_id(), F.lit(leaves)).alias("leaf"))
    copies = hashes.withColumn("leaf", F.explode(F.sequence(F.lit(0), F.lit(leaves - 1))))
    vectors = dealt.groupBy("shard", "leaf").cogroup(copies.groupBy("shard", "leaf")).applyInArrow(leaf, kind)
    while leaves > 1:
        leaves = -(-leaves // FAN_IN)
        vectors = vectors.withColumn("leaf", F.floor(F.col("leaf") / FAN_IN).cast("int")).groupBy("shard", "leaf").applyInArrow(add, kind)
    return cut_lineage(hashes.join(vectors.drop("leaf"), "shard")), shards, size


def _tasks(df: DataFrame) -> int:
    return (df.select(F.spark_partition_id().alias("task")).agg(F.max("task")).first()[0] or 0) + 1


def _vector(shard: int, leaf: int, vector: np.ndarray) -> pa.Table:
    return pa.table({"shard": pa.array([shard], pa.int32()), "leaf": pa.array([leaf], pa.int32()), "counts": pa.array([vector.tobytes()], pa.binary())})


def read_hash(levels: list[bytes], pairs: bytes) -> PerfectHash:
    return PerfectHash([np.frombuffer(x, np.uint64) for x in levels], np.frombuffer(pairs, np.int64))


class Counts:
    """The counts of the pairs of some shards, looked up by their hash."""

    def __init__(self, shards: int, rows: list[tuple[int, list[bytes], bytes, bytes]]):
        self.shards = shards
        self.of = {shard: (read_hash(levels, pairs), np.frombuffer(counts, np.int64)) for shard, levels, pairs, counts in rows}
        self.highest = np.zeros(1 << _BITS, np.int64)
        for hash_, counts in self.of.values():
            np.maximum.at(self.highest, hash_.keys >> _BITS, counts)

    def __call__(self, links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The links' counts and whether each is the highest of its first id; 0 and False for pairs of other shards."""
        out, first = np.zeros(len(links), np.int64), links >> _BITS
        shard = first % self.shards
        for number, (hash_, counts) in self.of.items():
            at = np.flatnonzero(shard == number)
            if len(at):
                found = hash_(links[at])
                if (found < 0).any():
                    raise ValueError("a pair was not counted: the texts changed between the passes")
                out[at] = counts[found]
        return out, (out > 0) & (out == self.highest[first])


COLUMNS = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


def _looked_up(docs: DataFrame, key: str, text: str, paths: tuple[str, str], shared, groups: bool) -> DataFrame:
    """Every row's numbers with the counts of one block."""

    def run(batches):
        name, shards, rows = shared.value
        worker = worker_of((*paths, name, groups), lambda: Counted(pair_of(*paths), Counts(shards, rows), groups))
        for batch, texts in _slices(batches):
            out = worker.numbers(texts)
            columns = [pa.array(c, type=pa.int64()) for c in list(zip(*out))[:6]] + [pa.array([r[6] for r in out], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("body"), *columns], names=names)

    names = ["key", "body", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    kind = docs.schema[key].dataType.simpleString()
    source = docs.select(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("body"), F.col(text).alias("text"))
    return source.mapInArrow(run, f"key {kind}, body long, {COLUMNS}")


def align(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups`` for every row.

    ``path_a`` is a byte-level vocabulary, which gets a space in front of the text, ``path_b`` one of pieces, which adds
    it; strings of special tokens are plain text. A text that is null, empty or not given back byte for byte by both
    has zeros and an empty string. Tokens are grouped between the bytes where both end one; two tokens whose bytes
    overlap are a link, and a pair's count is the number of rows that hold it linked (repeated rows count each).
    ``n_best`` are the links whose pair has the highest count of all pairs of its first id, ties included. Keys may be
    null or repeat; an empty table gives no rows.

    Counts are looked up in broadcast blocks of at most ``BLOCK_PAIRS`` pairs (or one shard); with more pairs, the texts
    are aligned again for every block and the blocks' sums added by row.
    """
    hashed, shards, size = hashed_counts(pair_counts(docs, path_a, path_b, text))
    per_block = max(1, shards * BLOCK_PAIRS // max(1, size))
    context, out = docs.sparkSession.sparkContext, None
    for first in range(0, shards, per_block):
        rows = [tuple(r) for r in hashed.filter(F.col("shard").between(first, first + per_block - 1)).select("shard", "levels", "pairs", "counts").collect()]
        rows = [(s, [bytes(x) for x in levels], bytes(p), bytes(c)) for s, levels, p, c in rows]
        block = _looked_up(docs, key, text, (path_a, path_b), context.broadcast((uuid.uuid4().hex, shards, rows)), groups=first == 0)
        if out is None:
            out = block
            continue
        # rows with one key and one text have the same sums
        more = block.select(F.col("key").alias("k"), F.col("body").alias("b"), F.col("n_best").alias("more_best"), F.col("count_sum").alias("more_sum")).distinct()
        out = out.join(more, F.col("key").eqNullSafe(F.col("k")) & F.col("body").eqNullSafe(F.col("b")), "left")
        out = out.withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))})
        out = out.drop("k", "b", "more_best", "more_sum")
    return out.select(F.col("key").alias(key), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")
