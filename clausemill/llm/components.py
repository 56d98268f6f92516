"""Links inside hash buckets and connected components, as joins and aggregations over tables of edges."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausemill.session import work_folder

#: Members of a bucket that all its members are tested against first.
CENTRES = 2
#: Members of a bucket that are compared pair by pair.
PAIRED = 64
#: Lists in which the keys that hold a member are gathered.
PARTS = 64
#: Numbers of 64 bits in the sketch of a set.
SKETCH_WORDS = 8
#: Edges (two numbers each) that one task handles.
EDGES_PER_TASK = 1 << 18


def written(df: DataFrame, folder: str | None = None) -> DataFrame:
    """``df`` written to the shared folder (a new one, or ``folder`` in place of what is there) and read again, which cuts its lineage."""
    folder = folder or work_folder(df.sparkSession, "links")
    df.write.mode("overwrite").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def connected(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` for every node of ``edges`` (``a``, ``b``) that is not the smallest of its component.

    Large-star and small-star steps in turn until nothing changes: each node is re-linked to the smallest node next to
    it. Minima combine before they are shuffled and every step is joins of plain edges, so a node with very many
    neighbours is never gathered. The rounds are written to two folders in turn, so that each replaces one that is no longer read.
    """
    folder, other = (work_folder(edges.sparkSession, "links") for _ in range(2))
    pairs = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), folder)
    before, size = None, pairs.count()
    while True:
        pairs = pairs.coalesce(_tasks(size))
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(lowest, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(lowest, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lowest.select("u", F.col("m").alias("v")))
        folder, other = other, folder
        pairs = written(small.filter("u <> v").distinct().coalesce(_tasks(size)), folder)
        state = pairs.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_003).alias("s"), F.sum(F.hash("u", "v").cast("long")).alias("h")
        ).first()
        if state == before:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before, size = state, state["n"]


def _tasks(edges: int) -> int:
    """Tasks that read or write a table of so many edges, which shrinks to few files as components close."""
    return 1 + edges // EDGES_PER_TASK


#: Words of 64 bits in the table of :func:`thinned`: at most so many small rows are broadcast.
FILTER_WORDS = 1 << 18


def marked(rows: DataFrame, column: str, keys: DataFrame, mark: str) -> DataFrame:
    """``rows`` with ``mark``: whether ``column``, a 64-bit hash, may be the ``key`` of a row of ``keys``.

    True for all that are, and for few others: a table of at most ``FILTER_WORDS`` rows with a bit per key is broadcast,
    so that rows can be told apart before a shuffle. With so many keys that the bits fill up the mark tells less, and
    the join that follows decides alone.
    """

    def bit(value):
        return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(value, F.lit(64)).cast("int"))

    def word(value):
        return F.pmod(F.shiftright(value, 6), F.lit(FILTER_WORDS)).cast("int")

    table = keys.select(word(F.col("key")).alias("_word"), bit(F.col("key")).alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    joined = rows.withColumn("_word", word(F.col(column))).join(F.broadcast(table), "_word", "left")
    found = F.coalesce(F.col("_bits").bitwiseAND(bit(F.col(column))) != 0, F.lit(False))
    return joined.withColumn(mark, found).drop("_word", "_bits")


def thinned(rows: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """The rows whose ``column`` may be in ``keys``."""
    return marked(rows, column, keys, "_marked").filter("_marked").drop("_marked")


def bucket_members(buckets: DataFrame) -> DataFrame:
    """The distinct rows of ``buckets`` (``bucket``, ``key``, ``size``) whose bucket has several keys, written once.

    Keys of a bucket meet as a minimum and a maximum, which combine before the shuffle; ``buckets`` is read twice.
    """
    several = buckets.groupBy("bucket").agg(F.min("key").alias("low"), F.max("key").alias("high")).filter("low < high")
    several = written(several.select("bucket"))
    likely = thinned(buckets, "bucket", several.withColumnRenamed("bucket", "key"))
    return written(likely.join(several, "bucket").distinct())


@dataclass(frozen=True)
class Similarity:
    """How two items are compared: columns of a pair's items ``a``, ``b``.

    ``similar`` decides on the items. ``sizes`` tells from two items' sizes whether they can be similar at all, ``prefix`` how
    many members of an item of a size are enough to share one with every similar item, and ``enough`` whether two items of
    given sizes can be similar with so many members in common.
    """

    sizes: Callable[[Column, Column], Column]
    prefix: Callable[[Column], Column]
    enough: Callable[[Column, Column, Column], Column]
    similar: Callable[[Column, Column], Column]


def link_members(members: DataFrame, items: DataFrame, similarity: Similarity) -> DataFrame:
    """The components (``node``, ``root``) of all keys that share a bucket and are similar.

    ``members`` has distinct ``bucket``, ``key``, ``size`` rows; ``items`` has a row per key with its ``item``. Every bucket first
    tests its members against ``CENTRES`` of them; members that are connected by then need no further test. What is left,
    pairs in one bucket and in different components, meets as plain keys where their sizes allow it, once for all buckets
    that a pair shares; items join only these pairs. Members of buckets that still hold more than ``PAIRED`` meet by their
    rarest members instead (:func:`_rare_members`), which finds all similar ones; what shares such a member is first tested
    against ``CENTRES`` of its keys too. No link is lost, and a large group of copies costs a few rows per member.
    """
    links = _similar(_centred(members.withColumn("label", F.col("key")), similarity), items, similarity)
    labelled = _labelled(members, connected(links))
    open_ = labelled.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("held")).filter("low < high")
    rest = written(labelled.join(open_.select("bucket", "held"), "bucket"))
    crowded = written(rest.filter(F.col("held") > PAIRED).select("key", "size", "label").distinct())
    rest = rest.filter(F.col("held") <= PAIRED).drop("held")
    pairs = None
    if not crowded.isEmpty():
        rare = _rare_members(crowded, items, similarity)
        links = links.unionByName(_similar(_centred(rare, similarity), items, similarity))
        roots = connected(links)
        rest, rare = (_labelled(x.drop("label"), roots) for x in (rest, rare))
        pairs = _pairs(rare, similarity, _room(similarity))
    few = _pairs(rest, similarity)
    pairs = (few if pairs is None else few.unionByName(pairs)).distinct()
    return connected(links.unionByName(_similar(pairs, items, similarity)))


def _centred(buckets: DataFrame, similarity: Similarity) -> DataFrame:
    """The pairs ``a``, ``b`` of every member of ``buckets`` (``bucket``, ``key``, ``size``, ``label``) and one of ``CENTRES``
    members of its bucket, if they have different labels and sizes that allow it."""
    orders = [F.xxhash64("key", F.lit(turn)) if turn else F.col("key") for turn in range(CENTRES)]
    chosen = [F.min(F.struct(order.alias("order"), "key", "size", "label")).alias(f"c{turn}") for turn, order in enumerate(orders)]
    centres = buckets.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), *chosen).filter("low < high")
    centres = centres.select("bucket", F.array(*[f"c{turn}" for turn in range(CENTRES)]).alias("centres"))
    near = F.filter("centres", lambda c: (c["label"] != F.col("label")) & similarity.sizes(F.col("size"), c["size"]))
    pairs = buckets.join(centres, "bucket").select("key", F.explode(F.transform(near, lambda c: c["key"])).alias("centre"))
    return pairs.select(F.least("key", "centre").alias("a"), F.greatest("key", "centre").alias("b")).distinct()


def _pairs(buckets: DataFrame, similarity: Similarity, more: Column | None = None) -> DataFrame:
    """The pairs ``a``, ``b`` of members of one bucket with different labels, sizes that allow it, and ``more``."""
    left, right = (buckets.select(*[F.col(x).alias(f"{side}_{x}") for x in buckets.columns]) for side in "ab")
    apart = (F.col("a_bucket") == F.col("b_bucket")) & (F.col("a_label") < F.col("b_label")) & similarity.sizes(F.col("a_size"), F.col("b_size"))
    met = left.join(right, apart if more is None else apart & more)
    return met.select(F.least("a_key", "b_key").alias("a"), F.greatest("a_key", "b_key").alias("b"))


def _rare_members(crowded: DataFrame, items: DataFrame, similarity: Similarity) -> DataFrame:
    """The rarest members of the sets of ``crowded`` keys (``key``, ``size``, ``label``) as buckets in which all similar ones meet.

    With all sets in one order, two similar ones share a member among the first ``prefix`` of each. The order is by how many
    of these sets hold a member, rarest first, so that what very many have in common brings no pair together early. A
    member's count meets ``PARTS`` lists of the keys that hold it, not every key. ``left`` members follow from this one on:
    from the first that two sets share, all others they share come later in both. ``bits`` is the set's sketch.
    """
    each = items.join(crowded.select("key"), "key").repartition("key").select("key", F.explode("item").alias("member"))
    parts = written(each.groupBy("member", F.pmod("key", F.lit(PARTS)).alias("part")).agg(F.collect_list("key").alias("keys")))
    counts = parts.groupBy("member").agg(F.sum(F.size("keys")).alias("sets"))
    counted = parts.join(counts, "member").repartition("member", "part").select(F.explode("keys").alias("key"), "sets", "member")
    ordered = counted.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("sets", "member"))).alias("members"))
    ordered = ordered.withColumn("bits", _sketch(F.transform("members", lambda m: m["member"])))
    begin = F.slice("members", F.lit(1), similarity.prefix(F.col("size")))
    first = ordered.join(crowded, "key").select("key", "size", "label", "bits", F.posexplode(begin).alias("at", "m")).filter("m.sets > 1")
    return written(first.select(F.col("m.member").alias("bucket"), "key", "size", "label", (F.col("size") - F.col("at")).alias("left"), "bits"))


def _sketch(members: Column) -> Column:
    """Bits that each member of a set of 64-bit hashes flips one of: two sets differ by at least as many members as bits."""

    def word(i):
        one = F.lit(1).cast("long")
        return F.aggregate(
            F.filter(members, lambda x: F.pmod(F.shiftright(x, 6), F.lit(SKETCH_WORDS)) == i), F.lit(0).cast("long"),
            lambda bits, x: bits.bitwiseXOR(F.call_function("shiftleft", one, F.pmod(x, F.lit(64)).cast("int"))),
        )

    return F.struct(*[word(i).alias(f"w{i}") for i in range(SKETCH_WORDS)])


def _room(similarity: Similarity) -> Column:
    """Whether two sets that share a rare member can be similar, by the members left in both and by their sketches."""
    odd = sum((F.bit_count(F.col(f"a_bits.w{i}").bitwiseXOR(F.col(f"b_bits.w{i}"))) for i in range(SKETCH_WORDS)), F.lit(0))
    a, b = F.col("a_size"), F.col("b_size")
    return similarity.enough(F.least("a_left", "b_left"), a, b) & similarity.enough((a + b - odd) / 2, a, b)


def _similar(pairs: DataFrame, items: DataFrame, similarity: Similarity) -> DataFrame:
    """The similar ones of the pairs ``a``, ``b`` of keys, written once."""
    left, right = (items.select(F.col("key").alias(side), F.col("item").alias(f"{side}_item")) for side in "ab")
    judged = pairs.join(left, "a").join(right, "b").filter(similarity.similar(F.col("a_item"), F.col("b_item")))
    return written(judged.select("a", "b"))


def _labelled(members: DataFrame, roots: DataFrame) -> DataFrame:
    named = roots.select(F.col("node").alias("key"), "root")
    return members.join(named, "key", "left").withColumn("label", F.coalesce("root", "key")).drop("root")


def overlap_of_sets(percent: int) -> Similarity:
    """Sets of 64-bit hashes whose intersection has at least ``percent`` % of the size of the union."""

    def sizes(a, b):
        return 100 * F.least(a, b) >= percent * F.greatest(a, b)

    def enough(common, a, b):
        return (100 + percent) * common >= percent * (a + b)

    return Similarity(
        sizes=sizes,
        prefix=lambda n: (n - F.ceil(n * percent / F.lit(100)) + 1).cast("int"),
        enough=enough,
        similar=lambda a, b: enough(F.size(F.array_intersect(a, b)), F.size(a), F.size(b)),
    )
