import random

from clausemill.llm.queries import QUERIES
from clausemill.llm.toxicity import counterfactual, fit, fit_rows, score

FOLDER = "/root/testdata/sf0.1"


def biased_rows():
    """Insults mark label 1; a neutral group term happens to stand in most of these texts."""
    draw = random.Random(3)
    filler = [f"word{i}" for i in range(300)]
    rows = []
    for i in range(400):
        text = draw.sample(filler, 12)
        toxic = i % 2
        if toxic:
            text += ["dreadful" if i % 4 == 1 else "vile"]
        if draw.random() < (0.5 if toxic else 0.02):
            text.append("muslim")
        elif draw.random() < 0.3:
            text.append("christian")
        draw.shuffle(text)
        rows.append((toxic, " ".join(text)))
    return rows


def test_swapping_changes_little():
    rows = biased_rows()
    plain, fair = fit_rows(rows, fairness=0.0).scorer(), fit_rows(rows).scorer()
    neutral = "word1 word2 the muslim word3 market word9"
    swapped = " ".join(counterfactual(neutral.split()))
    assert "christian" in swapped
    assert abs(fair(neutral) - fair(swapped)) < 0.5 * abs(plain(neutral) - plain(swapped))
    assert fair(neutral) < plain(neutral) and fair(neutral) < 0.5
    assert fair("word4 vile word5") > 0.5 and fair("word4 dreadful muslim") > 0.5


def test_held_out_accuracy(spark):
    found = QUERIES["op7_toxicity"](spark, FOLDER)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    rows = found.filter("held_out").join(labels, "doc_id").filter("toxic is not null").collect()
    toxic = [r for r in rows if r["toxic"]]
    clean = [r for r in rows if not r["toxic"]]
    assert sum(r["predicted"] for r in toxic) >= 0.85 * len(toxic) > 0
    assert sum(r["predicted"] for r in clean) <= 0.02 * len(clean)


def test_edges(spark):
    rows = [(i, f"some calm words {i % 7} " + ("vile scum " if i % 4 == 1 else "")) for i in range(60)]
    rows += [(None, "vile scum"), (100, None), (101, ""), (102, "calm " * 200000 + "vile scum"), (5, rows[5][1])]
    docs = spark.createDataFrame([(*r, 1.5, "x") for r in rows], "doc_id long, text string, score double, label string").repartition(4)
    labels = spark.createDataFrame([(i, int(i % 4 == 1)) for i in range(60)] + [(3, None), (None, 1), (9, 0)], "doc_id long, toxic int")
    found = score(docs, fit(docs, labels), ["doc_id"]).collect()
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 for r in found)
    by = {r["doc_id"]: r["score"] for r in found}
    assert by[102] > 0.5 and by[100] == by[101] < 0.5 < by[None]
    none = labels.limit(0)
    assert {r["score"] for r in score(docs, fit(docs, none), ["doc_id"]).collect()} == {0.5}
    assert score(docs.limit(0), fit(docs.limit(0), labels), ["doc_id"]).count() == 0


def test_a_marker_of_most_toxic_texts_counts():
    """However many of the toxic texts hold the marker, it is learnt; a word that is in most texts of either class is not."""
    for share in (0.5, 0.7, 0.9, 1.0):
        draw = random.Random(2)
        rows = []
        for n in range(600):
            words = [f"w{draw.randrange(300)}" for _ in range(30)] + ["everywhere"]
            if n % 2 and draw.random() < share:
                words.insert(draw.randrange(30), "zzmarkerzz")
            rows.append((n % 2, " ".join(words)))
        model = fit_rows(rows)
        score = model.scorer()
        clean = " ".join(f"w{k}" for k in range(30)) + " everywhere"
        assert score(clean + " zzmarkerzz") > 0.8 and score(clean) < 0.5 + 0.2 * (share < 0.7), share
        assert abs(score(clean) - score(clean.replace(" everywhere", ""))) < 0.05
