"""Fuzzy duplicates among the lines of a corpus: MinHash bands, exact Jaccard, components, one line kept of each."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import bucket_members, link_members, marked, overlap_of_sets, thinned, written
from .host_quality import WORD_CHARACTER, WORD_GAP, bound

#: Characters of a shingle; at the end of a line shingles are shorter.
WIDTH = 12
SIMILAR_PERCENT = 80
#: Bands per line and hashes per band: a pair at 80 % of long lines shares a band with probability 1 - (1 - 0.8^3)^8 = 0.997.
BANDS, ROWS = 8, 3
#: Of lines with at most so many shingles, two are similar only if their sets are equal or one lacks a single member.
FEW = 7
#: Sets of fewer members are not similar to one that lacks a member of theirs.
LACKING = 5


def normal(line: Column) -> Column:
    """What is compared of a line: lower case, white space collapsed, without spaces at its ends."""
    odd = functools.reduce(lambda a, b: a | b, [F.contains(line, F.lit(x)) for x in ("  ", "\t", "\r", "\x0b", "\x0c")])
    return F.trim(F.lower(F.when(odd, F.regexp_replace(line, WORD_GAP, " ")).otherwise(line)))


def shingles(line: Column) -> Column:
    """The sorted distinct 64-bit hashes of the shingles of a normalised line.

    Words are what stands between single spaces. A shingle starts at every word and takes ``WIDTH`` characters of it and the
    two words after it; of a word of more characters every other character starts one too, which ends with the word. So
    every character of a line is in a shingle.
    """

    def inside(w):
        return F.slice(F.regexp_extract_all(w, F.lit(r"(?s)(?=(.{1,%d}))." % WIDTH), F.lit(1)), F.lit(2), F.length(w))

    def of(words):
        starts = F.transform(words, lambda w, i: F.xxhash64(F.substring(F.concat_ws(" ", w, F.get(words, i + 1), F.get(words, i + 2)), 1, WIDTH)))
        long_ = F.filter(words, lambda w: F.length(w) > WIDTH)
        more = F.flatten(F.transform(long_, lambda w: F.transform(inside(w), lambda s: F.xxhash64(s))))
        return F.sort_array(F.array_distinct(F.concat(starts, more)))

    return bound(F.split(line, " "), of)


def bands(hashes: Column) -> Column:
    """``BANDS`` hashes of a set, each of its ``ROWS`` smallest members after one point of the circle of hashes.

    That is a one-permutation MinHash whose empty bins borrow from the next.
    """
    step = (1 << 64) // BANDS
    points = F.array(*[F.lit(-(1 << 63) + i * step).cast("long") for i in range(BANDS)])

    def after(both, point, i):
        before = F.array_position(both["line"], point).cast("int") - 1 - i  # hashes in front of the point
        return F.xxhash64(i, F.slice(both["circle"], before + 1, both["rows"]))

    def around(h):
        both = F.struct(
            F.sort_array(F.concat(h, points)).alias("line"), F.concat(h, F.slice(h, 1, ROWS)).alias("circle"),
            F.least(F.lit(ROWS), F.size(h)).alias("rows"),
        )
        return bound(both, lambda b: F.transform(points, lambda p, i: after(b, p, i)))

    return bound(hashes, around)


def buckets(hashes: Column) -> Column:
    """The buckets of a set: its bands, or where it has at most ``FEW`` members those where all similar sets of so few meet.

    Such sets are similar only if they are equal or one is the other without a member, so they meet at a hash of the
    whole set and of the set without each member. The next larger sets are in both.
    """

    def mixed(values):
        return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(F.xxhash64(x)))

    def without(h):
        return bound(mixed(h), lambda m: F.transform(h, lambda x: F.xxhash64(F.lit(BANDS), m.bitwiseXOR(F.xxhash64(x)))))

    def few(h):
        whole = F.array(F.xxhash64(F.lit(BANDS), mixed(h)))
        return F.when(F.size(h) < LACKING, whole).otherwise(F.concat(whole, without(h)))

    def chosen(h):
        return F.when(F.size(h) <= FEW, few(h)).when(F.size(h) == FEW + 1, F.concat(bands(h), few(h))).otherwise(bands(h))

    return bound(hashes, chosen)


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``body`` (a hash of the whole text), ``n`` (from 0), ``norm`` of every line with a word."""
    hashed = docs.select(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("body"), F.col(text).alias("text"))
    cut = hashed.select("key", "body", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return cut.filter(F.col("line").rlike(WORD_CHARACTER)).select("key", "body", "n", normal(F.col("line")).alias("norm"))


def texts_of(found: DataFrame, keys: DataFrame) -> DataFrame:
    """``key``, ``norm`` of the lines whose key is in ``keys``, once each."""
    likely = thinned(found.select(F.xxhash64("norm").alias("key"), "norm"), "key", keys)
    return likely.join(keys, "key", "left_semi").dropDuplicates(["key"])


def signed_lines(found: DataFrame) -> DataFrame:
    """``key``, ``body``, ``n``, ``line_key``, ``size`` and ``bands`` of every line, written once."""
    sketch = bound(shingles(F.col("norm")), lambda s: F.struct(F.size(s).alias("size"), buckets(s).alias("bands")))
    rows = found.select("key", "body", "n", F.xxhash64("norm").alias("line_key"), sketch.alias("sketch"))
    return written(rows.select("key", "body", "n", "line_key", "sketch.size", "sketch.bands"))


def shared_lines(found: DataFrame, signed: DataFrame) -> DataFrame:
    """``line_key``, ``first`` (``key``, ``n``) for the keys of lines that have an equal or similar line, written once."""
    members = bucket_members(signed.select(F.col("line_key").alias("key"), "size", F.explode("bands").alias("bucket")))
    asked = written(members.select("key").distinct())
    items = written(texts_of(found, asked).select("key", shingles(F.col("norm")).alias("item")))
    roots = link_members(members, items, overlap_of_sets(SIMILAR_PERCENT))
    named = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    place = F.struct(F.isnull("key").alias("last"), "key", "n")
    own = signed.groupBy("line_key").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("lines"))
    several = own.join(named.withColumnRenamed("node", "line_key"), "line_key", "left").filter("lines > 1 OR root IS NOT NULL")
    several = written(several.select("line_key", F.coalesce("root", "line_key").alias("group"), "first"))
    firsts = several.groupBy("group").agg(F.min("first").alias("first"))
    return written(several.drop("first").join(firsts, "group").select("line_key", F.struct("first.key", "first.n").alias("first")))


def places(docs: DataFrame, key: str, text: str, shared: bool) -> DataFrame:
    """``key``, ``body``, ``n``, ``first_key``, ``first_n``, ``kept`` of lines that have a partner (and all others).

    Lines are read from the table of signed ones; the first lines of the groups are joined only to lines that a small
    broadcast table does not rule out.
    """
    found = lines(docs, key, text)
    signed = signed_lines(found)
    firsts = shared_lines(found, signed)
    keys = firsts.select(F.col("line_key").alias("key"))
    split = marked(signed.select("key", "body", "n", "line_key"), "line_key", keys, "likely")
    joined = split.filter("likely").join(firsts, "line_key", "left")
    own = F.struct("key", "n")
    out = joined.select("key", "body", "n", F.coalesce("first", own).alias("first"))
    if not shared:
        out = out.unionByName(split.filter("NOT likely").select("key", "body", "n", own.alias("first")))
    kept = F.col("key").eqNullSafe(F.col("first.key")) & (F.col("n") == F.col("first.n"))
    return out.select("key", "body", "n", F.col("first.key").alias("first_key"), F.col("first.n").alias("first_n"), kept.alias("kept"))


def line_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``body``, ``n``, ``first_key``, ``first_n``, ``kept`` for every line with a word.

    Lines with the same normal form, or whose sets of shingles overlap by ``SIMILAR_PERCENT`` % of their union, directly or
    over others, are one group. ``first_key``, ``first_n`` is the place of its first line, by key (null last) and line
    number, and ``kept`` marks that line; where rows of the input repeat, all their copies of it. Lines meet by 64-bit
    hashes of their normal form. Null and empty texts have no lines, blank lines belong to no group, and an empty table
    gives no rows.
    """
    return places(docs, key, text, shared=False).withColumnRenamed("key", key)


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows and columns of ``docs``; of every group of lines only the first line is left in the texts.

    Blank lines stay. A text all of whose lines with a word are dropped becomes the empty string; null stays null.
    """
    groups = places(docs, key, text, shared=True).filter(~F.col("kept"))
    dropped = groups.groupBy(F.col("key").alias("dropped_key"), F.col("body").alias("dropped_body")).agg(F.collect_set("n").alias("dropped"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    old = F.col("row").getField(text)
    same = F.col("row").getField(key).eqNullSafe(F.col("dropped_key")) & (F.xxhash64(old) == F.col("dropped_body"))

    def rest(parts):
        kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("dropped"))
        return bound(kept, lambda k: F.array_join(F.transform(k, lambda i: F.get(parts, i)), "\n"))

    joined = packed.join(dropped, same, "left")
    body = F.when(F.col("dropped").isNull(), old).otherwise(bound(F.split(old, "\n"), rest))
    blank = ~F.coalesce(body, F.lit("")).rlike(WORD_CHARACTER)
    body = F.when(F.col("dropped").isNotNull() & blank, F.lit("")).otherwise(body)
    return joined.select(*[body.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns])
