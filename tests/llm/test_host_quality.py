import random
import re

from pyspark.sql import functions as F

from clausemill.llm.host_quality import host_rates, host_verdicts, measures, prior


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    places = {}
    for i in range(len(words) - 2):
        places.setdefault(tuple(words[i : i + 3]), []).append(i)
    repeated = {i + k for at in places.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated)
    )


def test_measures_of_odd_texts(spark):
    draw = random.Random(1)
    texts = [None, "", " \t\n\x0b\x0c\r ", "one", "one two", "a b c", "a b c a b c", "a a a", "a a a a", "x\nx\n\n \nx", "é\u00a0ö #*$%&|<>", "𝒳𝒴 b"]
    texts += [" ".join(draw.choices("abcd", k=draw.randint(0, 60))) for _ in range(150)]
    texts += [" ".join(f"w{i}" for i in range(20000)), " ".join(f"w{i % 700}" for i in range(30000)), "same line\n" * 5000]
    texts += [" ".join(draw.choices([f"v{i}" for i in range(2000)], k=40000))]
    rows = [(i if i != 4 else None, t, "h", 9) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_words int").repartition(4)
    got = {r["doc_id"]: tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for r in measures(docs).collect()}
    for i, text, *_ in rows:
        assert got[i] == plain(text), (text or "")[:80]


def test_host_verdicts(spark):
    good, bad = " ".join(f"w{i}" for i in range(60)), "too short"
    rows = [(i, good if i % 10 else bad, "fine") for i in range(100)]
    rows += [(200 + i, bad if i % 10 else good, "spam") for i in range(100)]
    rows += [(400, good, None), (401, bad, None), (402, good, "new"), (403, bad, "unlucky"), (402, good, "new")]
    found = host_verdicts(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(found) == len(rows)
    by = {r["doc_id"]: r for r in found}
    assert by[1]["kept"] and not by[0]["kept"] and not by[200]["kept"] and not by[201]["kept"]
    assert by[402]["kept"] and 0 < by[402]["host_rate"] < by[403]["host_rate"] < 1 and not by[403]["kept"]
    assert not by[200]["base_failed"] and by[200]["host_rate"] > 0.5


def test_prior_without_spread_and_empty_table(spark):
    judged = spark.createDataFrame([("a", True), ("a", False), ("b", True), ("b", False)], "host string, base_failed boolean")
    assert {r["rate"] for r in host_rates(judged).collect()} == {0.5}
    assert host_rates(judged.limit(0)).count() == 0
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert host_verdicts(docs).count() == 0
    nulls = spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")
    assert [r["kept"] for r in host_verdicts(nulls.withColumn("kept", F.lit(True))).collect()] == [False]


def test_windows_with_equal_hashes_are_compared_by_words(spark, monkeypatch):
    draw = random.Random(6)
    texts = [" ".join(draw.choices("abcdef", k=draw.randint(4, 60))) for _ in range(40)] + ["a b c d e f g h"]
    hashed = F.xxhash64
    monkeypatch.setattr(F, "xxhash64", lambda *c: hashed(*c).bitwiseAND(F.lit(3 << 60)))
    docs = spark.createDataFrame([(i, t, "h") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {r["doc_id"]: r["n_repeat_words"] for r in measures(docs).collect()}
    assert got == {i: plain(t)[4] for i, t in enumerate(texts)}


def test_many_small_hosts_are_shrunk_to_the_mean(spark):
    """Thousands of hosts with one text each beside a large one: a single failure says little about a host."""
    rows = [(f"h{i}", i % 5 == 0) for i in range(3000)] + [("big", i % 5 == 0) for i in range(1000)]
    rows += [("three", True), ("three", True), ("three", False)]
    found = {r["host"]: r["rate"] for r in host_rates(spark.createDataFrame(rows, "host string, base_failed boolean")).collect()}
    assert all(abs(found[h] - 0.2) < 0.05 for h in ("h0", "h1", "big", "three"))


def test_moments_recover_a_known_prior(spark):
    draw = random.Random(5)
    rows = []
    for h in range(400):
        p = draw.betavariate(2, 6)
        rows += [(f"h{h}", draw.random() < p) for _ in range(draw.choice([1, 2, 10, 40]))]
    frame = spark.createDataFrame(rows, "host string, flag boolean")
    hosts = frame.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.count_if("flag").alias("x")).collect()
    n, x = [r["n"] for r in hosts], [r["x"] for r in hosts]
    mean, weight = prior(len(n), sum(n), sum(x), sum(k * k for k in n), sum(a * a / k for a, k in zip(x, n)), 10.0)
    assert abs(mean - 0.25) < 0.03 and 5 < weight < 13
    rates = {r["host"]: r["rate"] for r in host_rates(frame, "flag").collect()}
    assert all(abs(rates[r["host"]] - (r["x"] + mean * weight) / (r["n"] + weight)) < 1e-9 for r in hosts)


def test_every_rule_has_its_own_rate(spark):
    good = " ".join(f"w{i}" for i in range(60))
    signs, lines = good + " " + "#" * 60, "\n".join([good] + ["same line of text"] * 30 + [f"v{i} x{i}" for i in range(50)])
    rows = [(i, good if i % 10 else signs, "fine") for i in range(60)] + [(100 + i, signs if i % 10 else good, "signs") for i in range(60)]
    rows += [(200 + i, lines, "lines") for i in range(60)]
    by = {r["doc_id"]: r for r in host_verdicts(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert by[1]["kept"] and by[0]["kept"] and not by[0]["base_failed"] and by[0]["symbols"]
    assert by[100]["rate_symbols"] > 0.8 > 0.2 > by[100]["rate_dup_lines"] and not by[100]["kept"] and not by[100]["base_failed"]
    assert by[200]["rate_dup_lines"] > 0.8 and not by[200]["kept"]
