"""Near-duplicate texts by min-max hashing of word shingles, exact similarity and components."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausemill.session import cut_lineage

from .components import bucket_members, link_members, overlap_of_sets

#: Permutations; the smallest and the largest hash under each make 128 signature values.
PERMUTATIONS = 64
#: Values per band: of 25 bands, a pair at 80 % shares one with probability 1 - (1 - 0.8^5)^25 = 0.99995.
ROWS = 5
#: Shingles hashed at a time.
PIECE = 1 << 14
REMEMBERED = 300_000
#: Bits in the table that tells which texts' sets are needed again (2 MB; fuller with very many, then it drops fewer).
FILTER_BITS = 24
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})


def _constants(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


FLIPS, FACTORS = _constants(11), _constants(12)
#: The order in which signature values are cut into bands: bands mix smallest and largest values.
ORDER = np.random.default_rng(13).permutation(2 * PERMUTATIONS)


class Shingles:
    """Texts to their sorted distinct shingle hashes."""

    def __init__(self, width: int):
        self.width, self.known = width, {}

    def __call__(self, text: str | None) -> np.ndarray:
        known, found = self.known, []
        if len(known) > REMEMBERED:
            known.clear()
        for word in WORD.findall((text or "").translate(LOWER)):
            value = known.get(word)
            if value is None:
                value = known[word] = xxhash.xxh64_intdigest(word)
            found.append(value)
        tokens = np.array(found, np.uint64)
        width = min(self.width, len(tokens))
        if not width:
            return tokens
        mixed = np.full(len(tokens) - width + 1, width, np.uint64)
        for place in range(width):
            mixed = (mixed ^ tokens[place : place + len(mixed)]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        return np.unique(mixed)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The smallest and the largest hash of the set under each permutation: one evaluation gives two values."""
    low = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(PERMUTATIONS, np.uint64)
    for start in range(0, len(shingles), PIECE):
        hashed = (shingles[start : start + PIECE][None, :] ^ FLIPS[:, None]) * FACTORS[:, None]
        np.minimum(low, hashed.min(axis=1), out=low)
        np.maximum(high, hashed.max(axis=1), out=high)
    return np.concatenate([low, high])[ORDER]


def bands(shingles: np.ndarray) -> list[int]:
    """A 64-bit hash per band; none for an empty set."""
    if not len(shingles):
        return []
    values = signature(shingles)
    count = len(values) // ROWS
    mixed = np.arange(1, count + 1, dtype=np.uint64)
    for row in values[: count * ROWS].reshape(count, ROWS).T:
        mixed = (mixed ^ row) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(31)
    return mixed.view(np.int64).tolist()


def digest(shingles: np.ndarray) -> int:
    """A 64-bit number of the whole set."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def _mapped(docs: DataFrame, key: str, text: str, kind: str, make: Callable) -> DataFrame:
    """``make()`` maps a text to the fields after ``key``; texts that it maps to None are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        work = make()
        for batch in batches:
            rows = [(k, *found) for k, t in zip(batch["key"].array, batch["text"]) if (found := work(t)) is not None]
            yield pd.DataFrame(rows, columns=names)

    source = docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
    names = ["key", *(part.split()[0] for part in kind.split(","))]
    return source.mapInPandas(run, f"key string, {kind}")


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """``key``, ``n_shingles``, ``component_id``, ``kept`` for every row.

    A text's set are its distinct shingles of ``width`` words (A-Z lower-cased, split at ASCII white space); of a shorter
    text all words as one; none without words. Texts whose sets overlap by ``percent`` % of the union, directly or over
    others, are a component; ``component_id`` is its smallest key and ``kept`` marks the row with it. Texts without words are
    alone. Equal sets meet by a 64-bit digest first, so copies of one text are one node whatever their number. A null
    key is never the smallest and kept only if its component has no other; a repeated row is judged as its copy.
    """
    judged = _judged(docs, key, text, width, percent)
    return judged.select(F.col("key").alias(key), "n_shingles", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))


def _judged(docs: DataFrame, key: str, text: str, width: int, percent: int) -> DataFrame:
    """``key``, ``body`` (a hash of the text), ``n_shingles``, ``group``, ``component_id`` for every row."""
    kind = docs.schema[key].dataType

    def sketch():
        shingles = Shingles(width)

        def work(value):
            found = shingles(value)
            body = xxhash.xxh64_intdigest((value or "").encode(), seed=42)
            return body - (1 << 64) if body >> 63 else body, len(found), digest(found), bands(found)

        return work

    rows = cut_lineage(_mapped(docs, key, text, "body long, n_shingles long, digest long, bands array<long>", sketch))
    rows = rows.withColumn("key", F.col("key").cast(kind))
    members = bucket_members(rows.select(F.explode("bands").alias("bucket"), F.col("digest").alias("key"), F.col("n_shingles").alias("size")))
    sets = needed_sets(docs, members.select("key").distinct(), text, width)
    roots = link_members(members, sets, overlap_of_sets(percent)).select(F.col("node").alias("digest"), "root")
    named = rows.select("key", "body", "n_shingles", "digest").join(roots, "digest", "left").withColumn("group", F.coalesce("root", "digest"))
    empty = F.col("n_shingles") == 0
    firsts = named.filter(~empty).groupBy("group").agg(F.min("key").alias("first"))
    judged = named.join(firsts, "group", "left")
    component = F.when(empty, F.col("key")).otherwise(F.col("first"))
    return judged.select("key", "body", "n_shingles", "group", component.alias("component_id"))


def needed_sets(docs: DataFrame, keys: DataFrame, text: str, width: int) -> DataFrame:
    """``key`` (digest), ``item`` (the set) of the texts whose digest is in ``keys``, once each, written once.

    Workers get a table of ``2**FILTER_BITS`` bits that marks the digests and leave other texts out.
    """
    at = F.pmod("key", F.lit(1 << FILTER_BITS))
    word, bit = F.shiftright(at, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int")).alias("bit")
    words = keys.select(word, bit).groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()  # at most 2**18 rows
    table = np.zeros(1 << FILTER_BITS - 6, np.int64)
    table[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    marks = docs.sparkSession.sparkContext.broadcast(table)

    def collect():
        shingles, marked = Shingles(width), marks.value.view(np.uint64)

        def work(value):
            found = shingles(value)
            number = digest(found)
            place = number % (1 << FILTER_BITS)
            if not len(found) or not int(marked[place >> 6]) >> (place & 63) & 1:
                return None
            return number, found.view(np.int64)

        return work

    sets = _mapped(docs.select(F.lit(None).alias("nothing"), F.col(text)), "nothing", text, "digest long, set array<long>", collect)
    sets = sets.withColumnRenamed("digest", "number").select(F.col("number").alias("key"), F.col("set").alias("item"))
    return cut_lineage(sets.join(keys, "key", "left_semi").dropDuplicates(["key"]))


def near_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of every component, and all without words.

    The row that stays has the smallest key (null last), then the smallest hash of its text; of its exact repeats (same key,
    same text) one is left. Rows are told apart by key and hash together, so keys may repeat or be null.
    """
    rows = cut_lineage(_judged(docs, key, text, width, percent).filter("n_shingles > 0").select("group", "key", "body"))
    place = F.struct(F.isnull("key").alias("last"), "key", "body")
    firsts = rows.groupBy("group").agg(F.min(place).alias("first"))
    counted = rows.groupBy("group", "key", "body").agg(F.count(F.lit(1)).alias("rows")).join(firsts, "group")
    stays = F.col("key").eqNullSafe(F.col("first.key")) & (F.col("body") == F.col("first.body"))
    judged = counted.filter(~stays | (F.col("rows") > 1)).select(F.col("key").alias("_key"), F.col("body").alias("_body"), stays.alias("_stays"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    packed = packed.withColumns({"own": F.col("row").getField(key), "hash": F.xxhash64(F.coalesce(F.col("row").getField(text), F.lit("")))})
    joined = packed.join(judged, F.col("own").eqNullSafe(F.col("_key")) & (F.col("hash") == F.col("_body")), "left").filter("_stays IS NULL OR _stays")
    once = joined.filter("_stays").dropDuplicates(["own", "hash"])
    return joined.filter("_stays IS NULL").unionByName(once).select("row.*")
