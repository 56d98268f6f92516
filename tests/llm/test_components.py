import random

from pyspark.sql import functions as F
from test_line_dedup import union

from clausemill.llm import components

LINKED = "key long, item array<long>"


def test_near_copies_in_one_bucket_are_not_paired(spark, monkeypatch):
    """Near copies that differ about as much as they may: the pairs that are compared grow with the copies, and no link is lost."""
    draw = random.Random(5)
    base, pool = ([draw.getrandbits(64) - (1 << 63) for _ in range(n)] for n in (100, 60))
    sets = {}
    for key in range(500):
        out = draw.randrange(4, 12)
        sets[key] = frozenset(draw.sample(base, 100 - out) + draw.sample(pool, out))
    keys = sorted(sets)
    links = [(a, b) for a in keys for b in keys[a + 1 :] if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    find, tested, similar = union(links), [], components._similar

    def counted(pairs, *more):
        tested.append(pairs.count())
        return similar(pairs, *more)

    monkeypatch.setattr(components, "_similar", counted)
    items = spark.createDataFrame([(k, list(s)) for k, s in sets.items()], LINKED)
    members = items.select(F.lit(1).cast("long").alias("bucket"), "key", F.size("item").alias("size"))
    got = {r["node"]: r["root"] for r in components.link_members(members, items, components.overlap_of_sets(80)).collect()}
    assert got == {k: find(k) for k in keys if find(k) != k}
    assert len(links) > 4 * len(keys)
    assert sum(tested) < 20 * len(keys), tested


def test_sketch_never_exceeds_the_difference(spark):
    draw = random.Random(6)
    rows = []
    for _ in range(200):
        both = [draw.getrandbits(64) - (1 << 63) for _ in range(draw.randrange(0, 80))]
        rows.append(tuple(both + [draw.getrandbits(64) - (1 << 63) for _ in range(draw.randrange(0, 60))] for _ in "ab"))
    pairs = spark.createDataFrame(rows, "a array<long>, b array<long>").select("a", "b", components._sketch(F.col("a")).alias("s"), components._sketch(F.col("b")).alias("t"))
    total = [0, 0]
    for r in pairs.collect():
        odd, apart = sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(r["s"], r["t"])), len(set(r["a"]) ^ set(r["b"]))
        assert odd <= apart and (apart - odd) % 2 == 0
        total = [total[0] + odd, total[1] + apart]
    assert total[0] > 0.8 * total[1]
