import random
import re

from pyspark.sql import functions as F

from clausemill.llm.components import connected
from clausemill.llm.line_dedup import SIMILAR_PERCENT, WIDTH, dedup_lines, line_groups

FOLDER = "/root/testdata/sf0.001"


def sets(line):
    """12 characters from every word on, of it and the two words after it, and from every character of longer words up to their end."""
    words = re.sub(r"[\x20\x09-\x0D]+", " ", line.lower()).strip(" ").split(" ")
    found = {" ".join(words[i : i + 3])[:WIDTH] for i in range(len(words))}
    return frozenset(found | {w[i : i + WIDTH] for w in words if len(w) > WIDTH for i in range(1, len(w))})


def union(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return find


def brute(docs):
    """(doc, line number) to the first place of its group, by comparing all distinct lines."""
    places, known = {}, {}
    for doc, text in docs:
        for n, line in enumerate((text or "").split("\n")):
            if line.strip(" \t\n\x0b\x0c\r"):
                places[doc, n] = sets(line)
    distinct = sorted(set(places.values()), key=lambda s: (len(s), sorted(s)))
    index = {s: i for i, s in enumerate(distinct)}
    links, by = [], {}
    for i, s in enumerate(distinct):
        for x in s:
            by.setdefault(x, []).append(i)
    for i, s in enumerate(distinct):
        counts = {}
        for x in s:
            for j in by[x]:
                if j < i:
                    counts[j] = counts.get(j, 0) + 1
        links += [(i, j) for j, c in counts.items() if 100 * c >= SIMILAR_PERCENT * (len(s) + len(distinct[j]) - c)]
    find = union(links)
    for place in sorted(places):
        known.setdefault(find(index[places[place]]), place)
    return {place: known[find(index[s])] for place, s in places.items()}, len(links)


def groups(df):
    return {(r["doc_id"], r["n"]): (r["first_key"], r["first_n"]) for r in line_groups(df).collect()}


def test_components_of_random_graphs(spark):
    draw = random.Random(2)
    pairs = [(draw.randrange(300), draw.randrange(300)) for _ in range(220)] + [(1000, i) for i in range(1001, 1100)] + [(i, i + 1) for i in range(2000, 2060)]
    find = union(pairs)
    got = {r["node"]: r["root"] for r in connected(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for p in pairs for x in p if find(x) != x}


def test_whole_table_equals_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    expected, links = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = groups(docs)
    assert set(got) == set(expected) and links
    wrong = [p for p in expected if got[p] != expected[p]]
    assert len(wrong) <= 0.002 * len(expected)  # the bands' recall


def test_edited_lines_and_edges(spark):
    draw = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz "
    base = ["".join(draw.choices(letters, k=k)).strip() + "." for k in (300, 200, 120)]
    docs = []
    for d in range(30):
        text = list(base[d % 3])
        for _ in range(d // 10):
            text[draw.randrange(len(text))] = "Q"
        docs.append((d, "".join(text) + "\n\n" + ("same short" if d % 2 else f"line {d}")))
    long_line = "".join(draw.choices(letters, k=60000))
    docs += [(40, None), (41, ""), (42, "\n \n"), (43, long_line), (44, long_line[1:]), (45, "x" * 5000), (None, base[0])]
    frame = spark.createDataFrame([(*d, "e", 1) for d in docs], "doc_id long, text string, line string, n int").repartition(4)
    expected, _ = brute([d for d in docs if d[0] is not None])
    got = groups(frame)
    assert got.pop((None, 0)) == expected[0, 0]
    assert got == expected
    left = {r["doc_id"]: r["text"] for r in dedup_lines(frame).collect()}
    assert dedup_lines(frame).columns == frame.columns and len(left) == len(docs)
    for d, text in docs[:-1]:
        parts = (text or "").split("\n")
        rest = "\n".join(x for n, x in enumerate(parts) if expected.get((d, n), (d, n)) == (d, n))
        dropped = rest != (text or "")
        assert left[d] == (None if text is None else ("" if dropped and not rest.strip() else rest))
    assert left[None] == ""


def test_repeated_rows_and_empty_table(spark):
    frame = spark.createDataFrame([(1, "one line of text here\nother"), (1, "one line of text here\nother"), (2, "other")], "doc_id long, text string")
    assert [r["text"] for r in dedup_lines(frame).orderBy("doc_id").collect()] == ["one line of text here\nother"] * 2 + [""]
    assert dedup_lines(frame.limit(0)).count() == 0
    nulls = frame.withColumn("text", F.lit(None).cast("string"))
    assert dedup_lines(nulls).count() == 3
