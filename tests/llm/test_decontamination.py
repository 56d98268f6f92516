import itertools
import random

import pytest

from clausemill.llm.decontamination import MASKS, SHORTEST, WINDOW, contaminated, decontaminate, needed
from clausemill.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def words(text):
    import re

    return re.findall(r"\w+", (text or "").lower())


def brute(docs, items):
    """Every alignment of every pair, without seeds: the pairs that match."""
    out = set()
    for (d, text), (i, passage) in itertools.product(docs, items):
        t, p = words(text), words(passage)
        window = min(WINDOW, len(p))
        if i is None or len(p) < SHORTEST:
            continue
        where = {}
        for place, word in enumerate(t):
            where.setdefault(word, []).append(place)
        shifts = {a - b for b, word in enumerate(p) for a in where.get(word, ())}
        for shift in shifts:
            first, last = max(0, -shift), min(len(p), len(t) - shift)
            equal = [t[x + shift] == p[x] for x in range(first, last)]
            if any(sum(equal[x : x + window]) >= needed(window) for x in range(len(equal) - window + 1)):
                out.add((d, i))
                break
    return out


def test_some_mask_fits_beside_any_allowed_differences():
    for window in range(SHORTEST, WINDOW + 1):
        for bad in itertools.combinations(range(window), window - needed(window)):
            assert any(all(s + o not in bad for o in mask) for mask in MASKS for s in range(window - mask[-1]))


def test_query_equals_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    found = QUERIES["op9_decontamination"](spark, FOLDER).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == brute(docs, items) and found


def planted():
    draw = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(draw.choices(vocabulary, k=draw.choice([5, 8, 9, 12, 13, 14, 30, 60])))) for i in range(40)]
    docs = []
    for d in range(200):
        text = draw.choices(vocabulary, k=draw.choice([0, 3, 40, 200]))
        if d % 3:
            passage = words(items[draw.randrange(40)][1])
            for _ in range(draw.choice([0, 1, 2, 4])):
                passage[draw.randrange(len(passage))] = "changed"
            at = draw.randint(0, len(text))
            text[at:at] = passage[draw.choice([0, 0, 3]) :]
        docs.append((d, " ".join(text).upper() if d % 2 else ", ".join(text)))
    return docs, items


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_planted_passages_equal_brute_force(spark, block):
    docs, items = planted()
    docs += [(None, items[6][1]), (500, None), (501, ""), (502, "x " * 300000 + items[7][1]), (0, docs[0][1])]
    items += [(77, None), (None, "a b c d e f g h i j k l m n"), (3, items[8][1])]
    frame = spark.createDataFrame([(*d, 5, "t") for d in docs], "doc_id long, text string, item_id int, leak string").repartition(5)
    passages = spark.createDataFrame(items, "item_id long, text string")
    found = contaminated(frame, passages, block_tokens=block).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == brute(docs, items)
    for r in found:
        assert r["equal"] >= needed(r["compared"])
    kept = decontaminate(frame, passages, block_tokens=block)
    assert kept.columns == frame.columns
    leaky = {r["doc_id"] for r in found}
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(d) for d, _ in docs if d not in leaky)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert contaminated(docs, items).count() == 0 and decontaminate(docs, items).count() == 1
    assert contaminated(docs.limit(0), docs.withColumnRenamed("doc_id", "item_id")).count() == 0


@pytest.mark.parametrize("kind", ["long", "string"])
def test_passages_without_a_number_are_found(spark, kind):
    passage, other = "a b c d e f g h i j k l m n", "n m l k j i h g f e d c b a"
    docs = spark.createDataFrame([(1, f"x y {passage} z"), (2, f"{other} {passage}"), (3, "x y z")], "doc_id long, text string")
    items = spark.createDataFrame([(None, passage), (None if kind == "long" else "q7", other)], f"item_id {kind}, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in contaminated(docs, items).collect()) == [(1, None), (2, None), (2, None)]
    assert [r["doc_id"] for r in decontaminate(docs, items).collect()] == [3]
