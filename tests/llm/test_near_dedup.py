import random

import numpy as np

from clausemill.llm.near_dedup import PERMUTATIONS, Shingles, near_dedup, near_groups, signature
from clausemill.llm.queries import QUERIES

from test_line_dedup import union

FOLDER = "/root/testdata/sf0.01"
LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})


def shingle_set(text, width):
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in (text or "").translate(LOWER)).split(" ") if w]
    width = min(width, len(words))
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1)) if words else frozenset()


def brute(docs, width, percent=80):
    """doc to (set size, smallest reachable doc) with all pairs that share a shingle compared."""
    sets = {d: shingle_set(t, width) for d, t in docs}
    by, links = {}, []
    order = sorted(sets)
    for d in order:
        counts = {}
        for s in sets[d]:
            for other in by.setdefault(s, []):
                counts[other] = counts.get(other, 0) + 1
            by[s].append(d)
        links += [(other, d) for other, c in counts.items() if 100 * c >= percent * (len(sets[d]) + len(sets[other]) - c)]
    find = union(links)
    return {d: (len(sets[d]), find(d)) for d in order}, links


def test_signature_is_minimum_and_maximum():
    found = Shingles(2)("a b c d e f g a b c")
    values = signature(found)
    assert len(values) == 2 * PERMUTATIONS and len(found) == 7
    draw = np.random.default_rng(1)
    pool = draw.integers(0, 1 << 63, 4000, dtype=np.uint64)
    agree = np.mean([(signature(pool[i : i + 900]) == signature(pool[i + 100 : i + 1000])).mean() for i in range(0, 3000, 50)])
    assert abs(agree - 0.8) < 0.02


def test_query_equals_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    expected, links = brute(docs, 2)
    rows = QUERIES["op6_minhash_near_dedup"](spark, FOLDER).collect()
    assert len(links) > 10 and len(rows) == len(docs)
    for r in rows:
        assert (r["n_shingles"], r["component_id"]) == expected[r["doc_id"]]
        assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_chain_of_edits_and_edges(spark):
    draw = random.Random(4)
    words = [f"w{i}" for i in range(500)]
    text = draw.choices(words, k=150)
    docs = []
    for d in range(60):  # a chain whose ends have nothing in common, and a group around its start
        docs.append((d, " ".join(text)))
        if d % 2:
            at = draw.randrange(140)
            text[at : at + 6] = draw.choices(words, k=6)
    for d in range(100, 180):
        copy = docs[0][1].split()
        for _ in range(draw.randrange(14)):
            copy[draw.randrange(len(copy))] = draw.choice(words)
        docs.append((d, " ".join(copy).title() if d % 2 else " \n".join(copy)))
    docs += [(200, None), (201, ""), (202, " \t\n"), (203, "one"), (204, "ONE "), (205, "one two"), (206, "w1 " * 60000), (207, "w1 w1"), (208, "é É"), (209, "É é")]
    frame = spark.createDataFrame([(*d, 7, "x") for d in docs], "doc_id long, text string, kept int, digest string").repartition(6)
    for width in (2, 5):
        expected, links = brute(docs, width)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_groups(frame, width=width).collect()}
        assert got == expected and links
        assert sorted(r["doc_id"] for r in near_dedup(frame, width=width).collect()) == sorted(d for d, e in expected.items() if e[1] == d)
    assert near_dedup(frame).columns == frame.columns


def test_nulls_repeats_and_empty_table(spark):
    rows = [(1, "a b c"), (1, "a b c"), (None, "a b c"), (None, "q r s"), (3, "a b c"), (None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in near_groups(frame, width=2).collect())
    assert got == sorted([("1", "1", True), ("1", "1", True), ("None", "1", False), ("None", "None", True), ("3", "1", False), ("None", "None", True)])
    assert near_groups(frame.limit(0)).count() == 0


def test_rows_with_one_key_are_told_apart(spark):
    rows = [(1, "a b c d", "x"), (5, "a b c d", "y"), (5, "q r s t", "z"), (7, "k l m n", "u"), (7, "k l m n", "v"), (8, "A b c d", "w")]
    rows += [(None, "q r s t", "n"), (None, "e f g h", "o"), (None, "e f g h", "o"), (None, "E f g h", "p"), (9, "", "e"), (9, "", "e"), (None, None, "e")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, tag string").repartition(3)
    got = [(r["doc_id"], (r["text"] or "").lower()) for r in near_dedup(frame, width=2).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(1, "a b c d"), (5, "q r s t"), (7, "k l m n"), (None, "e f g h"), (9, ""), (9, ""), (None, "")]))
