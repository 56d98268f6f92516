import random
import re
from collections import Counter, defaultdict
from itertools import permutations

from clausemill.llm import filter_audit
from clausemill.llm.filter_audit import audit, first_ids
from clausemill.llm.text_trie import TextTrie, shared_prefix

COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def failures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = "A" if len(words) < 200 else ""
    out += "B" if 100 * len(set(words)) < 50 * len(words) else ""
    out += "C" if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text) else ""
    return out + ("D" if re.search(r"[#$%&*|]", text) else "")


def brute(docs, labels):
    """Every order applied to every document, one filter after the other."""
    fails, rows = [], {}
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    for d, text, part in docs:
        copy = d is not None and any(other is not None and other < d and (t or "") == (text or "") for other, t, _ in docs)
        fails.append((d, part or "", failures(text or "") + ("E" if copy else "")))
    parts, shapley = {p for _, p, _ in fails}, defaultdict(int)
    for order in map("".join, permutations("ABCDE")):
        for part in parts:
            left = [(d, f) for d, p, f in fails if p == part]
            removed_before = []
            for step, name in enumerate(order, 1):
                here = [(d, f) for d, f in left if name in f]
                left = [(d, f) for d, f in left if name not in f]
                shapley[part, name] += len(here)
                rows[part, order, step] = (
                    len(left), len(here), sum(name in f for _, f in removed_before), sum(f == name for _, p, f in fails if p == part),
                    sum(d in good for d, _ in here), sum(d in toxic for d, _ in here),
                )
                removed_before += here
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in rows.items()}


def got(spark, docs, labels):
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, source string, mask string").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = audit(frame, marks).collect()
    assert len(rows) == 600 * len({d[2] or "" for d in docs})
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in [*COUNTS, "shapley"]) for r in rows}


def corpus(seed):
    draw = random.Random(seed)
    docs = []
    for d in range(140):
        words = ["w%d" % draw.randrange(draw.choice([20, 400])) for _ in range(draw.choice([3, 150, 260]))]
        if draw.random() < 0.2:
            words.append("#tag")
        if draw.random() < 0.3:
            words = [w.upper() for w in words]
        docs.append((d, " ".join(words), draw.choice(["a", "b", "b", None, ""])))
    docs += [(200 + i, docs[draw.randrange(20)][1], draw.choice(["a", "c"])) for i in range(60)]
    return docs


def test_every_order_equals_brute_force(spark):
    docs = corpus(4)
    docs += [(None, docs[0][1], "a"), (None, "alone", "b"), (300, None, "c"), (301, "", "c"), (302, "  É", None), docs[5], docs[5], (5, "other text", "b")]
    docs += [(400, "long " * 60000, "a"), (401, "long " * 60000, "a"), (402, "x" * 200000, "c")]
    labels = [(d, d % 2, d % 3 % 2) for d in range(0, 260, 2)] + [(0, 0, 1), (0, 1, None), (None, 1, 1), (9999, 1, 1)]
    assert got(spark, docs, labels) == brute(docs, labels)


def test_one_text_in_most_rows_and_shared_prefixes(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "RANGE_BYTES", 1 << 17)
    monkeypatch.setattr(filter_audit, "LOCAL_BYTES", 1 << 12)
    start = "the same opening of very many texts " * 80
    docs = [(d, start + ("hot" if d % 3 else str(d // 6)), "s") for d in range(900)] + [(d + 2000, "z", "t") for d in range(300)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(5)
    lowest = {}
    for d, text, _ in docs:
        lowest[text] = min(d, lowest.get(text, d))
    assert Counter(r["key"] for r in first_ids(frame).collect()) == Counter(lowest.values())


def test_prefixes_grow_where_texts_share_their_start(spark):
    docs = [(d, "same start " * 4000 + str(d), "s") for d in range(12)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    start, ranges = filter_audit.prefixes(frame, "text", 4)
    assert frame.select(start).distinct().count() == 12 and ranges == 4


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit(docs, marks).count() == 0
    one = spark.createDataFrame([(1, "few words", "a")], docs.schema)
    assert {r["removed"] for r in audit(one, marks).filter("filter_order = 'ABCDE'").collect()} == {0, 1}


def test_trie():
    draw = random.Random(1)
    texts = ["".join(draw.choices("ab", k=draw.randrange(9))).encode() for _ in range(600)]
    trie, expected = TextTrie(), {}
    for n, text in enumerate(texts):
        key = None if n % 7 == 0 else draw.randrange(1000)
        trie.insert(text, key)
        known = expected.get(text)
        expected[text] = key if known is None else known if key is None else min(known, key)
    found = list(trie.terminals())
    assert len(found) == len(expected) and dict(found) == expected
    assert shared_prefix(b"abcd", b"abx") == 2 and shared_prefix(b"", b"a") == 0
