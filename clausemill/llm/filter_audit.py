"""How filters interact: what each of five filters removes in every order of applying them.

Duplicates are found in tries of whole texts, one per range of texts with a common prefix; the verdicts on a document
become a mask, and all orders are worked out from the counts of the 32 masks of a part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import permutations

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausemill.session import cut_lineage

from .text_trie import TextTrie

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITAL_PERCENT = 200, 50, 2
SYMBOLS = b"#$%&*|"
CAPITALS = bytes(range(65, 91))

#: A task's trie before the shuffle is handed over when its edges hold so many bytes.
LOCAL_BYTES = 32 << 20
#: Bytes of texts with one prefix above which the prefix is made longer.
RANGE_BYTES = 16 << 20
#: A prefix has so many characters at first, and a heavy one so many times more in every round.
FIRST_PREFIX, LONGER = 4, 4
#: Bytes of texts that are handed over in one batch.
BATCH_BYTES = 4 << 20


def mask_of(text: bytes) -> int:
    """The bits of the filters A to D that a text fails; words are separated by ASCII white space."""
    words = text.split()
    found = len(words) < MIN_WORDS
    found |= (100 * len(set(words)) < MIN_DISTINCT_PERCENT * len(words)) << 1
    capitals = len(text) - len(text.translate(None, CAPITALS))
    found |= (100 * capitals > MAX_CAPITAL_PERCENT * len(text.decode())) << 2
    return found | (len(text.translate(None, SYMBOLS)) < len(text)) << 3


def digest_of(text: bytes) -> int:
    value = xxhash.xxh64_intdigest(text)
    return value - (1 << 64) if value >> 63 else value


def _batches(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType], size: Callable) -> Iterator[pa.RecordBatch]:
    """The rows as record batches of about ``BATCH_BYTES``."""
    held, total = [], 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*held), kinds)], names=names)

    for row in rows:
        held.append(row)
        total += size(row)
        if total >= BATCH_BYTES:
            yield batch()
            held, total = [], 0
    if held:
        yield batch()


def masked(docs: DataFrame, key: str, part: str, text: str) -> DataFrame:
    """``key``, ``part``, ``digest``, ``mask`` (A to D) of every row."""

    def run(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            digests, masks = pa.array(map(digest_of, texts), pa.int64()), pa.array(map(mask_of, texts), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("part"), digests, masks], names=["key", "part", "digest", "mask"])

    rows = docs.select(
        F.col(key).cast("long").alias("key"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    return rows.mapInArrow(run, "key long, part string, digest long, mask int")


def prefixes(docs: DataFrame, text: str, tasks: int) -> tuple[Column, int]:
    """The adaptive prefix of a text, hashed, and how many ranges of them the texts need.

    Starts are counted by their bytes; where one holds more than a task should, its texts are told apart by a longer
    start, until all ranges are small or their texts end. The driver sees the heavy starts alone, at most one for each
    ``RANGE_BYTES`` (or share of a task) of input and round.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    total = docs.agg(F.sum(F.octet_length(body).cast("long"))).first()[0] or 0
    limit = max(1 << 16, min(RANGE_BYTES, total // (2 * tasks)))
    length, open_, column = FIRST_PREFIX, docs, F.xxhash64(F.substring(body, 1, FIRST_PREFIX))
    while total > limit:
        start = F.xxhash64(F.substring(body, 1, length))
        sizes = open_.groupBy(start.alias("start")).agg(F.sum(F.octet_length(body).cast("long")).alias("bytes"), F.max(F.length(body)).alias("longest"))
        heavy = [r["start"] for r in sizes.filter((F.col("bytes") > limit) & (F.col("longest") > length)).select("start").collect()]
        if not heavy:
            break
        long_ = F.xxhash64(F.substring(body, 1, length * LONGER))
        within = start.isin(heavy)
        open_, column, length = open_.filter(within), F.when(within, long_).otherwise(column), length * LONGER
    return column, max(tasks, total // RANGE_BYTES)


def first_ids(docs: DataFrame, key: str = "doc_id", text: str = "text", tasks: int | None = None) -> DataFrame:
    """``key``, ``digest``: of every distinct text its smallest key and 64-bit hash; null if no row of it has a key.

    Every task inserts its texts into a trie first, so that copies of one text leave it once. The texts move to the task
    of their prefix's range, which inserts them into one trie. A trie holds shared starts once.
    """
    tasks = tasks or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    start, ranges = prefixes(docs, text, tasks)
    rows = docs.select(F.col(key).cast("long").alias("key"), start.alias("range"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))

    def local(batches):
        def texts():
            tries: dict[int, TextTrie] = {}
            held = 0
            for batch in batches:
                for one, range_, value in zip(batch.column("key").to_pylist(), batch.column("range").to_pylist(), batch.column("text").to_pylist()):
                    trie = tries.get(range_)
                    if trie is None:
                        trie = tries[range_] = TextTrie()
                    before = trie.held
                    trie.insert(value, one)
                    held += trie.held - before
                    if held >= LOCAL_BYTES:
                        yield from out(tries)
                        tries, held = {}, 0
            yield from out(tries)

        def out(tries):
            for range_, trie in tries.items():
                for value, lowest in trie.terminals():
                    yield lowest, range_, value

        yield from _batches(texts(), ["key", "range", "text"], [pa.int64(), pa.int64(), pa.binary()], lambda r: 32 + len(r[2]))

    def whole(batches):
        trie = TextTrie()
        for batch in batches:
            for one, value in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                trie.insert(value, one)
        found = ((lowest, digest_of(value)) for value, lowest in trie.terminals())
        yield from _batches(found, ["key", "digest"], [pa.int64(), pa.int64()], lambda r: 16)

    distinct = rows.mapInArrow(local, "key long, range long, text binary")
    return distinct.repartition(ranges, "range").drop("range").mapInArrow(whole, "key long, digest long")


def judged(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """``key``, ``part``, ``mask`` (five bits, A lowest), ``good``, ``toxic`` for every row.

    A row fails E if a row with a smaller key has the same text; a row without a key has no smaller one. A null text is
    an empty one, a null part the empty string. ``labels`` has ``doc_id``, ``quality``, ``toxic``; of several rows for a
    key any that says 1 counts, and rows without a key count nowhere. Keys may repeat and other columns are not read.
    """
    rows = masked(docs, key, part, text)
    firsts = first_ids(docs, key, text).filter("key IS NOT NULL").withColumn("first", F.lit(True))
    marks = (
        labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("key"))
        .agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    )
    both = rows.join(firsts, ["key", "digest"], "left").join(marks, "key", "left")
    copy = F.col("first").isNull() & F.col("key").isNotNull()
    mask = F.col("mask") + F.when(copy, F.lit(1 << 4)).otherwise(F.lit(0))
    return both.select("key", "part", mask.alias("mask"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def steps() -> list[tuple[str, int, int, int]]:
    """``(order, step, bits of the filters before, bit of the filter)`` of all orders of the filters."""
    out = []
    for order in permutations(FILTERS):
        bits = [1 << FILTERS.index(f) for f in order]
        out += [("".join(order), n + 1, sum(bits[:n]), bits[n]) for n in range(len(bits))]
    return out


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """``part``, ``filter_order``, ``step``, ``kept``, ``removed``, ``redundant``, ``unique_fails``, ``good_lost``,
    ``toxic_lost``, ``shapley`` for each part, order and step, zeros included.

    Filters are applied from left to right; ``step`` is the place of the filter that the counts are about. What a document
    does in an order follows from its mask alone, so a part needs the counts of its masks, which combine before they are
    shuffled: a part with most rows is as light as others. A filter removes a document that fails ``n`` filters in
    one of ``n`` orders, the one with that filter first, which gives ``shapley``. An empty table has no parts and no rows.
    """
    counts = judged(docs, labels, key, text, part).groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("good").cast("long")).alias("good"), F.sum(F.col("toxic").cast("long")).alias("toxic")
    )
    rows = counts.groupBy("part").agg(
        *[F.array(*[F.sum(F.when(F.col("mask") == m, F.col(c)).otherwise(F.lit(0))) for m in range(MASKS)]).alias(c) for c in ("n", "good", "toxic")]
    )
    every = ", ".join(f"named_struct('filter_order', '{o}', 'step', {s}, 'before', {b}, 'bit', {f})" for o, s, b, f in steps())
    at = rows.select("*", F.expr(f"inline(array({every}))"))

    def total(column: str, when: Callable[[Column], Column]) -> Column:
        kept = F.transform(column, lambda x, m: F.when(when(m), x).otherwise(F.lit(0).cast("long")))
        return F.aggregate(kept, F.lit(0).cast("long"), lambda a, x: a + x)

    def fails(m):
        return m.bitwiseAND(F.col("bit")) != 0

    def gone(m):
        return m.bitwiseAND(F.col("before")) != 0

    def share(x, m):
        orders = reduce(lambda a, b: a + b, [F.shiftright(m, i).bitwiseAND(F.lit(1)) for i in range(len(FILTERS))])
        return F.when(fails(m), (x * F.lit(len(steps()) // len(FILTERS)) / orders).cast("long")).otherwise(F.lit(0).cast("long"))

    shapley = F.aggregate(F.transform("n", share), F.lit(0).cast("long"), lambda a, x: a + x)
    return at.select(
        "part", "filter_order", "step",
        total("n", lambda m: ~fails(m) & ~gone(m)).alias("kept"), total("n", lambda m: fails(m) & ~gone(m)).alias("removed"),
        total("n", lambda m: fails(m) & gone(m)).alias("redundant"), total("n", lambda m: m == F.col("bit")).alias("unique_fails"),
        total("good", lambda m: fails(m) & ~gone(m)).alias("good_lost"), total("toxic", lambda m: fails(m) & ~gone(m)).alias("toxic_lost"),
        shapley.alias("shapley"),
    )
