import hashlib
import math
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from clausemill.llm.disclosure import CONTEXT, DISCLOSURE, KEPT, KINDS, NEAR, find, luhn, sanitise, sums_before
from clausemill.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["n_email", "n_ip", "n_card", "n_phone", "base", "spans"]
# the patterns as they are stated, without possessive parts
STATED = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TERM = re.compile(r"[^\W\d_][^\W_]{2,}")


def passes_luhn(number):
    doubled = [int(c) * (1 + n % 2) for n, c in enumerate(reversed(number))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def valid(kind, value):
    number = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 16 <= len(number) <= 19 and passes_luhn(number)
    return kind != "phone" or 8 <= len(number) <= 15


def matched(kind, text):
    return [m for m in re.finditer(STATED[kind], text)]


def near(text, kind):
    """(value, terms around) of every value."""
    every = matched(kind, text)
    cuts = [0, *[e for m in every for e in m.span()], len(text)]
    out = []
    for n, m in enumerate(every):
        if not valid(kind, m[0]):
            continue
        before, after = text[cuts[2 * n] : cuts[2 * n + 1]], text[cuts[2 * n + 2] : cuts[2 * n + 3]]
        left = re.sub(r"^[^\x20\x09-\x0D]*", "", before[-CONTEXT:]) if len(before) > CONTEXT else before
        right = re.sub(r"[^\x20\x09-\x0D]*$", "", after[:CONTEXT]) if len(after) > CONTEXT else after
        for k in KINDS:
            left, right = re.sub(STATED[k], " ", left), re.sub(STATED[k], " ", right)
        terms = [t.lower() for t in TERM.findall(left)][-NEAR:] + [t.lower() for t in TERM.findall(right)][:NEAR]
        value = m[0].lower() if kind == "email" else m[0] if kind == "ip" else re.sub("[^0-9]", "", m[0])
        out.append((kind + ":" + value, tuple(terms)))
    return out


def brute(docs, share=DISCLOSURE):
    docs = [(d, t or "") for d, t in docs]
    windows, together, holding, count = defaultdict(set), defaultdict(set), defaultdict(set), defaultdict(int)
    of = {}
    for row in docs:
        met = {w for k in KINDS for w in near(row[1], k)}
        of[row] = met
        for value, terms in met:
            holding[value].add(row)
            for t in {*terms, *(x[:KEPT] + "*" for x in terms)}:
                windows[value, t].add(terms)
                together[value, t].add(row)
        words = {w.lower() for w in TERM.findall(row[1])}
        for t in words | {w[:KEPT] + "*" for w in words}:
            count[t] += 1

    def told(value, t):
        n, rare = len(together[value, t]), len(docs) / len(holding[value])
        return len(windows[value, t]) > 1 and rare > 1 and math.log(n / max(count[t], n) * rare) > share * math.log(rare)

    out, clean = [], []
    for row in docs:
        key, text = row
        spans = {k: [m.span() for m in matched(k, text) if valid(k, m[0])] for k in KINDS}
        flagged = {}
        for value, terms in of[row]:
            for t in terms:
                if told(value, t):
                    flagged[t] = min(flagged.get(t, True), not told(value, t[:KEPT] + "*"))
        masked = text
        for k in KINDS:
            masked = re.sub(STATED[k], lambda m, k=k: " " * len(m[0]) if valid(k, m[0]) else m[0], masked)
        extra = [f"term:{m.start()}:{m.end()}" for m in TERM.finditer(masked) if m[0].lower() in flagged]
        base = [f"{k}:{a}:{b}" for k in KINDS for a, b in spans[k]]
        out.append((key, *[len(spans[k]) for k in KINDS], ",".join(base), ",".join(base + extra)))
        clean.append((key, flagged))
    return out, clean


def rows(frame):
    return sorted(((r["doc_id"], *[r[c] for c in COLUMNS]) for r in find(frame).collect()), key=repr)


def card(draw):
    head = "4" + "".join(draw.choices("0123456789", k=14))
    return head + next(c for c in "0123456789" if passes_luhn(head + c))


def corpus(seed):
    draw = random.Random(seed)
    common = "please contact the office about this account today because payments were late again".split()
    people = [(("Nam" if c < "e" else 3 * c) + c + "person", f"{c}.x@mail{n}.example.com", f"+1 (555) 010-{1000 + n}") for n, c in enumerate("abcdefgh")]
    docs = []
    for d in range(120):
        words = draw.choices(common, k=30)
        if d % 2:
            name, mail, phone = people[d // 2 % 8]
            words[10:10] = [draw.choice([name, name.upper()]), "wrote" if d % 3 else "from", mail]
            words.append(phone if d % 4 == 1 else draw.choice(["10.0.0.%d" % (d % 7), card(draw), "1.2.3.999", "4111 1111 1111 1112"]))
            words.append(name)
        docs.append((d, " ".join(words)))
    copied = "Uniquely zorblat reveals zed@solo.example.org in this passage"
    return docs + [(200 + n, copied) for n in range(5)]


def test_corpus_equals_brute_force(spark):
    docs = corpus(2) + [(None, "Namaperson a.x@mail0.example.com"), (300, None), (301, ""), (302, "no data"), (3, "other text, +49 (0) 89-123456 here")]
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, body string, n int").repartition(4)
    expected, _ = brute(docs)
    assert rows(frame) == sorted(expected, key=repr)
    spans = {r[0]: r[-1] for r in expected}
    assert "term:" in spans[1] and "term:" not in spans[200] and not spans[302]  # a passage that was copied is no evidence
    assert all("term:" not in spans[d] for d in range(0, 120, 2))


def test_given_texts_equal_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    expected, _ = brute(docs)
    got = QUERIES["op13_personal_data"](spark, FOLDER).collect()
    want = sorted((d, *n, hashlib.sha256(base.encode()).hexdigest(), spans) for d, *n, base, spans in expected)
    assert sorted(tuple(r) for r in got) == want and any(r["n_email"] for r in got)


def test_edges_of_the_patterns(spark):
    draw = random.Random(9)
    letters = "ab1.%+@-  5+()"
    docs = [(d, "".join(draw.choices(letters, k=draw.randrange(60)))) for d in range(400)]
    docs += [(1000 + d, "".join(draw.choices("0123456789.- +", k=draw.randrange(80)))) for d in range(400)]
    docs += [
        (2000, "a@b.c%d@e.f x@y@z.com @a.b a@b a@b. a..b@c-d.e-f"), (2001, "1.2.3.4.5.6.7.8 0000255.1.1.1 256.1.1.1 1..2.3.4 00000000001.2.3.4"),
        (2002, "😀 é a@b.c 😀😀 1.2.3.4 " + card(draw)), (2003, "4" * 16 + " " + card(draw)[:4] + "-" + "1" * 40), (2004, "+1 (((((( +12345678. +1234567890123456"),
        (2005, "x" * 300000 + "@z" + ".y" * 50000), (2006, "1 " * 200000), (2007, "1." * 100000), (2008, "a@" * 100000), (2009, ("a@b.cd 1.2.3.4 ") * 4000),
        (2010, "+1" + "(" * 200000), (2011, "7" * 300000), (2012, "a@b" + "-" * 200000),
    ]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(8)
    big = {2005, 2007, 2011, 2012}  # the stated patterns need quadratic time there
    expected = [r for r in brute([d for d in docs if d[0] not in big])[0]]
    got = {r[0]: r for r in rows(frame)}
    for r in expected:
        assert got[r[0]][:6] == r[:6]
    assert got[2005][5] == "email:0:400002" and got[2007][2] == 25000 and got[2011][1:6] == (0, 0, 0, 0, "") and got[2012][5] == ""


def test_repeated_rows_and_empty_table(spark):
    docs = corpus(2)[:20]
    frame = spark.createDataFrame(docs + [docs[3], docs[3]], "doc_id long, text string")
    got = rows(frame)
    assert len(got) == 22 and len([r for r in got if r[0] == 3]) == 3 == got.count(next(r for r in got if r[0] == 3))
    assert find(frame.limit(0)).count() == 0 and sanitise(frame.limit(0)).columns == ["doc_id", "text"]


def test_sanitised_texts(spark):
    docs = corpus(2)
    frame = spark.createDataFrame([(*d, 7) for d in docs] + [(400, None, 7)], "doc_id long, text string, terms int").repartition(3)
    _, flagged = brute(docs + [(400, None)])
    flagged, texts = dict(flagged), dict(docs)
    out = sanitise(frame)
    assert out.columns == frame.columns
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got[400] is None and len(got) == len(docs) + 1 and any(not g for f in flagged.values() for g in f.values())
    for d, text in texts.items():
        assert not any(valid(k, m[0]) for k in KINDS for m in matched(k, got[d]))
        words = [w.lower() for w in TERM.findall(got[d])]
        assert not set(words) & set(flagged[d])
        if not flagged[d] and not any(valid(k, m[0]) for k in KINDS for m in matched(k, text)):
            assert got[d] == text
    short = [got[d] for d in texts if any(flagged[d].values())]
    assert all("*" in t for t in short)


def test_sums_and_check_digits(spark):
    one = spark.range(1)
    numbers = [3, 0, 5, 7, 11, 2, 9]
    got = one.select(sums_before(F.array(*[F.lit(n).cast("long") for n in numbers]), F.sequence(F.lit(0), F.lit(6)))).first()[0]
    assert got == [sum(numbers[:n]) for n in range(7)]
    assert one.select(luhn(F.lit("4111111111111111")), luhn(F.lit("4111111111111112"))).first()[:] == (True, False)
