"""Personal data in texts, and the terms that give it away: information-theoretic sanitisation in DataFrame functions.

Addresses and numbers are found by patterns. How much a term tells about one of them is estimated from the corpus: of
the documents that hold the term, the share in which the term stands near that value. A term that tells more than a
given share of the value's information is generalised, or removed where its generalisation tells as much.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausemill.functions.plan import settle
from clausemill.session import cut_lineage

from .components import thinned
from .host_quality import bound

KINDS = ("email", "ip", "card", "phone")
TERM_KIND = "term"
#: A match starts where the one before ended or where no longer one could; what is taken is not given back, so that the
#: patterns read a text once and need no stack, however long its runs of digits or letters are.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried.
HINTS: dict[str, Callable[[Column], Column]] = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"),
    "phone": lambda t: F.contains(t, F.lit("+")),
}
#: What a value is replaced by; none of these is a term.
LABELS = {"email": "[@]", "ip": "[ip]", "card": "[cc]", "phone": "[ph]"}
TERM = r"\p{L}[\p{L}\p{N}]{2,}"
GAP = r"\x20\x09-\x0D"

#: Terms on either side of a value that count as near it, and the characters in which they are looked for.
NEAR, CONTEXT = 8, 80
#: The share of a value's information that a term may give away.
DISCLOSURE = 0.9
#: Characters of a term that its generalisation keeps.
KEPT = 3


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, x: a + x)


def _div(a: Column, b: Column) -> Column:
    return ((a - a % b) / b).cast("int")


def sums_before(numbers: Column, wanted: Column) -> Column:
    """For each place of ``wanted`` the sum of the ``numbers`` in front of it.

    Sums of blocks of about the root of the length come first, so a place costs one block, not all that is before it.
    """

    def of(x):
        return bound(F.ceil(F.sqrt(F.size(x) + F.lit(1))).cast("int"), lambda b: bound(blocks(x, b), lambda o: F.transform(wanted, lambda i: at(x, b, o, i))))

    def blocks(x, b):
        each = F.transform(F.sequence(F.lit(0), _div(F.size(x), b)), lambda k: total(F.slice(x, k * b + 1, b)))
        return bound(each, lambda s: F.transform(s, lambda _, k: total(F.slice(s, F.lit(1), k))))

    def at(x, b, before, i):
        return F.get(before, _div(i, b)) + total(F.slice(x, _div(i, b) * b + 1, i % b))

    return bound(numbers, of)


def matches(text: Column, pattern: str) -> Column:
    """``(found, gaps)``: all matches and what stands around them, one more."""
    every = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.struct(F.array().cast("array<string>").alias("found"), F.array(text).alias("gaps"))
    return bound(every, lambda m: F.when(F.size(m) == 0, none).otherwise(F.struct(m.alias("found"), F.split(text, pattern, -1).alias("gaps"))))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the last of the digits is right: every second from the right counts twice, with the sum of its digits."""

    def worth(i):
        digit = F.substr(number, F.length(number) - i, F.lit(1)).cast("int")
        twice = digit * 2
        return F.when(i % 2 == 0, digit).otherwise(F.when(twice > 9, twice - 9).otherwise(twice)).cast("long")

    return total(F.transform(F.sequence(F.lit(0), F.length(number) - 1), worth)) % 10 == 0


def holds(kind: str, value: Column) -> Column:
    """Whether a match is of its kind."""
    if kind == "ip":
        parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(F.when(F.length(p) <= 3, F.nullif(p, F.lit(""))).cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return bound(digits(value), lambda d: F.when(F.length(d).between(16, 19), luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(digits(value)).between(8, 15)
    return F.lit(True)


def same_value(kind: str, value: Column) -> Column:
    """The form in which two spellings of a value are equal."""
    return F.lower(value) if kind == "email" else value if kind == "ip" else digits(value)


def near_terms(gap: Column, before: bool) -> Column:
    """The terms of a gap that stand near the value after (``before``) or before it, without other personal data."""
    side = F.substring(gap, -CONTEXT, CONTEXT) if before else F.substring(gap, 1, CONTEXT)
    whole = F.regexp_replace(side, f"^[^{GAP}]*" if before else f"[^{GAP}]*$", "")
    clean = F.when(F.length(gap) > CONTEXT, whole).otherwise(side)
    for kind in KINDS:
        clean = F.regexp_replace(clean, PATTERNS[kind], " ")
    terms = bound(clean, lambda c: F.transform(F.regexp_extract_all(c, F.lit(TERM), F.lit(0)), F.lower))
    return bound(terms, lambda t: F.slice(t, F.greatest(F.size(t) - NEAR + 1, F.lit(1)), F.lit(NEAR)) if before else F.slice(t, 1, NEAR))


def spans_of(kind: str, text: Column) -> Column:
    """``(start, end, value, near)`` of every value of a kind; ``near`` are the terms around it."""

    def spans(both):
        sizes = F.zip_with(both["found"], F.slice(both["gaps"], F.lit(1), F.size(both["found"])), lambda m, g: (F.length(m) + F.length(g)).cast("long"))
        places = sums_before(sizes, F.sequence(F.lit(0), F.size(both["found"]) - 1))

        def span(value, before, i):
            start = F.get(before, i) + F.length(F.get(both["gaps"], i))
            near = F.concat(near_terms(F.get(both["gaps"], i), True), near_terms(F.get(both["gaps"], i + 1), False))
            return F.struct(start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"), near.alias("near"))

        def placed(before):
            judged = F.transform(both["found"], lambda v, i: F.when(holds(kind, v), span(v, before, i)))
            return F.filter(judged, lambda s: s.isNotNull())

        return F.when(F.size(both["found"]) == 0, F.array().cast(SPANS)).otherwise(bound(places, placed))

    return F.when(HINTS[kind](text), bound(matches(text, PATTERNS[kind]), spans)).otherwise(F.array().cast(SPANS))


SPANS = "array<struct<start: bigint, end: bigint, value: string, near: array<string>>>"


def shown(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))


def values(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, ``body`` (a hash of the text) and the spans of each kind for every row."""
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.select("key", F.xxhash64("text").alias("body"), *[spans_of(k, F.col("text")).alias(k) for k in KINDS])


def generalised(term: Column) -> Column:
    return F.concat(F.substring(term, 1, KEPT), F.lit("*"))


def meetings(found: DataFrame) -> DataFrame:
    """``key``, ``body``, ``value``, ``term``, ``window``: a value, a term near it or its generalisation, and a hash of all terms there."""

    def named(kind):
        value = lambda s: F.concat(F.lit(kind + ":"), same_value(kind, s["value"])).alias("value")
        return F.transform(kind, lambda s: F.struct(value(s), s["near"].alias("near")))

    every = F.concat(*map(named, KINDS))
    held = found.filter(" OR ".join(f"size({k}) > 0" for k in KINDS)).select("key", "body", F.inline(every))
    terms = F.array_distinct(F.concat("near", F.transform("near", generalised)))
    return held.select("key", "body", "value", F.xxhash64("near").alias("window"), F.explode_outer(terms).alias("term")).distinct()


def documents_with(docs: DataFrame, text: str, terms: DataFrame) -> DataFrame:
    """``hash``, ``n``: rows that hold the terms (or a term so generalised) whose 64-bit hash is a ``key`` of ``terms``."""
    words = F.regexp_extract_all(F.col(text), F.lit(TERM), F.lit(0))
    lowered = bound(words, lambda w: F.transform(w, F.lower))
    hashes = bound(lowered, lambda w: F.array_distinct(F.concat(F.transform(w, lambda x: F.xxhash64(x)), F.transform(w, lambda x: F.xxhash64(generalised(x))))))
    each = docs.filter(F.col(text).isNotNull()).select(F.explode(hashes).alias("hash"))
    return thinned(each, "hash", terms).groupBy("hash").agg(F.count(F.lit(1)).alias("n"))


def disclosing(docs: DataFrame, met: DataFrame, text: str, share: float = DISCLOSURE) -> DataFrame:
    """``value``, ``term``, ``general``: terms that give away more than ``share`` of a value's information.

    With ``p(value)`` the share of documents that hold the value and ``p(value | term)`` the share of those with the term
    in which it stands near the value, their pointwise mutual information is ``log(p(value | term) / p(value))`` and the
    value's information ``-log p(value)``. Only terms that were seen near the value in two different surroundings count:
    one passage, however often it was copied, is no evidence. ``general`` tells whether the term's generalisation keeps
    within the share.
    """
    documents = docs.count()
    each = met.groupBy("value", "term", "key", "body").agg(F.min("window").alias("low"), F.max("window").alias("high"))
    pairs = each.filter("term IS NOT NULL").groupBy("value", "term").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.count(F.lit(1)).alias("both"))
    pairs = pairs.withColumn("hash", F.xxhash64("term"))
    alone = met.select("value", "key", "body").distinct().groupBy("value").agg(F.count(F.lit(1)).alias("holding"))
    seen = cut_lineage(pairs.filter("low < high").select("value", "term", "hash", "both"))
    counts = cut_lineage(documents_with(docs, text, seen.select(F.col("hash").alias("key")).distinct()))
    rare = F.lit(float(documents)) / F.col("holding")
    near = F.col("both") / F.greatest(F.coalesce("n", F.lit(0)), F.col("both"))
    told = F.log(near * rare) > F.lit(share) * F.log(rare)
    judged = seen.join(counts, "hash").join(alone, "value").select("value", "term", (told & (rare > 1)).alias("told"))
    judged = cut_lineage(judged.filter("told").select("value", "term"))
    whole, general = judged.filter("NOT term LIKE '%*'"), judged.filter("term LIKE '%*'").select("value", F.col("term").alias("shorter"), F.lit(True).alias("tells"))
    both = whole.withColumn("shorter", generalised(F.col("term"))).join(general, ["value", "shorter"], "left")
    return both.select("value", "term", F.col("tells").isNull().alias("general"))


def replaced(text: Column, kind: str, by: Callable[[Column], Column]) -> Column:
    """``text`` with every value of a kind replaced."""

    def joined(both):
        names = F.transform(both["found"], lambda v: F.when(holds(kind, v), by(v)).otherwise(v))
        return F.array_join(F.zip_with(both["gaps"], names, lambda g, n: F.concat(g, F.coalesce(n, F.lit("")))), "")

    return F.when(HINTS[kind](text), bound(matches(text, PATTERNS[kind]), joined)).otherwise(text)


def without_values(rows: DataFrame, column: str, by: Callable[[str, Column], Column]) -> DataFrame:
    """``rows`` with every value in the texts of ``column`` replaced, one kind after the other."""
    for kind in KINDS:
        rows = settle(rows.withColumn(column, replaced(F.col(column), kind, lambda v, kind=kind: by(kind, v))), [column])
    return rows


def term_spans(text: Column, terms: Column) -> Column:
    """``(start, end)`` of every occurrence of the ``terms``."""

    def spans(both):
        sizes = F.zip_with(both["found"], F.slice(both["gaps"], F.lit(1), F.size(both["found"])), lambda m, g: (F.length(m) + F.length(g)).cast("long"))
        known = F.filter(F.sequence(F.lit(0), F.size(both["found"]) - 1), lambda i: F.array_contains(terms, F.lower(F.get(both["found"], i))))

        def at(places):
            def span(before, i):
                start = before + F.length(F.get(both["gaps"], i))
                return F.struct(start.alias("start"), (start + F.length(F.get(both["found"], i))).alias("end"))

            return F.zip_with(sums_before(sizes, places), places, span)

        nothing = F.array().cast("array<struct<start: bigint, end: bigint>>")
        return F.when(F.size(both["found"]) == 0, nothing).otherwise(bound(known, at))

    return bound(matches(text, TERM), spans)


def changed(text: Column, general: Column, removed: Column) -> Column:
    """``text`` with generalised terms shortened and the others taken out."""

    def word(w):
        low = F.lower(w)
        return F.when(F.array_contains(removed, low), F.lit("[]")).when(F.array_contains(general, low), generalised(w)).otherwise(w)

    def joined(both):
        names = F.transform(both["found"], word)
        return F.array_join(F.zip_with(both["gaps"], names, lambda g, n: F.concat(g, F.coalesce(n, F.lit("")))), "")

    return bound(matches(text, TERM), joined)


def _of_documents(docs: DataFrame, key: str, text: str, share: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The values of every row, the terms to change by document, and the rows that have such terms, with their texts."""
    found = cut_lineage(values(docs, key, text))
    met = cut_lineage(meetings(found))
    told = disclosing(docs, met, text, share)
    own = met.join(told, ["value", "term"]).groupBy("key", "body", "term").agg(F.min("general").alias("general"))
    names = own.groupBy("key", "body").agg(
        F.collect_list("term").alias("terms"), F.filter(F.collect_list(F.when(F.col("general"), F.col("term"))), lambda t: t.isNotNull()).alias("general")
    )
    names = cut_lineage(names.select(F.col("key").alias("_key"), F.col("body").alias("_body"), "terms", "general"))
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("body", F.xxhash64("text"))
    rows = thinned(rows, "body", names.select(F.col("_body").alias("key")).distinct())
    same = F.col("key").eqNullSafe(F.col("_key")) & (F.col("body") == F.col("_body"))
    return found, names, rows.join(names, same).drop("_key", "_body")


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", share: float = DISCLOSURE) -> DataFrame:
    """``key``, ``n_email``, ``n_ip``, ``n_card``, ``n_phone``, ``base`` and ``spans`` for every row.

    Spans are ``kind:start:end`` in code points, the end exclusive, by kind and start, joined by commas. ``base`` are those
    of the patterns. ``spans`` has also the kind ``term``: every occurrence, outside of values, of a term that gives away
    a value of the document near which it stands there (see :func:`disclosing`). A document without values has no
    terms. A null or empty text has no spans. Documents are told apart by key and text, so keys may be null or repeat;
    a repeated row is one document where values are counted. An empty table gives no rows.
    """
    found, _, rows = _of_documents(docs, key, text, share)
    rows = without_values(rows, "text", lambda kind, v: F.repeat(F.lit(" "), F.length(v)))
    places = rows.select("key", "body", term_spans(F.col("text"), F.col("terms")).alias("places")).dropDuplicates(["key", "body"])
    extra = places.select(F.col("key").alias("_key"), F.col("body").alias("_body"), shown(TERM_KIND, F.col("places")).alias("extra"))
    base = F.concat(*[shown(k, F.col(k)) for k in KINDS])
    counted = found.select("key", "body", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], base.alias("base"))
    same = F.col("key").eqNullSafe(F.col("_key")) & (F.col("body") == F.col("_body"))
    both = counted.join(extra, same, "left")
    spans = F.array_join(F.concat("base", F.coalesce("extra", F.array().cast("array<string>"))), ",")
    return both.select(F.col("key").alias(key), *[f"n_{k}" for k in KINDS], F.array_join("base", ",").alias("base"), spans.alias("spans"))


def sanitise(docs: DataFrame, key: str = "doc_id", text: str = "text", share: float = DISCLOSURE) -> DataFrame:
    """All rows and columns of ``docs``; in ``text`` values are replaced by labels and disclosing terms generalised or removed.

    Texts without terms to change are not shuffled; null stays null.
    """
    _, names, _ = _of_documents(docs, key, text, share)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    old = F.col("row").getField(text)
    packed = packed.withColumns({"_own": F.col("row").getField(key), "_hash": F.xxhash64(F.coalesce(old, F.lit(""))), "_text": old})
    joined = packed.join(names, F.col("_own").eqNullSafe(F.col("_key")) & (F.col("_hash") == F.col("_body")), "left")
    joined = without_values(joined, "_text", lambda kind, _: F.lit(LABELS[kind]))
    body = changed(F.col("_text"), F.col("general"), F.array_except("terms", "general"))
    body = F.when(F.col("terms").isNull(), F.col("_text")).otherwise(body)
    return joined.select(*[body.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns])
