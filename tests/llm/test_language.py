import numpy as np
from pyspark.sql import functions as F

from clausemill.llm.language import BUCKETS, UNDETERMINED, codes, counts, fit, fit_rows, grams, held_out, identify, pieces
from clausemill.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_score(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang", "text")
    found = QUERIES["op5_language_id"](spark, FOLDER)
    assert found.columns == ["doc_id", "held_out", "lang_pred", "score"]
    rows = found.join(docs, "doc_id").filter("held_out and lang is not null").collect()
    assert found.count() == docs.count()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows) > 0
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_held_out_follows_crc32(spark):
    import zlib

    rows = spark.range(200).withColumn("out", held_out(F.col("id"), 3, 1)).collect()
    assert [r["out"] for r in rows] == [zlib.crc32(str(i).encode()) % 3 == 1 for i in range(200)]


def test_long_texts_count_every_gram(monkeypatch):
    found = codes("the quick brown fox jumps över the lazy dog " * 30)
    whole = np.concatenate(list(grams(found)))
    monkeypatch.setattr("clausemill.llm.language.PIECE", 37)
    cut = np.concatenate(list(pieces(found)))
    assert sorted(whole) == sorted(cut)
    at, share = counts(found)
    assert abs(share.sum() - 1) < 1e-9 and set(at) == set(whole)


def test_weights_are_sparse_and_calibrated():
    rows = [("aa", "kala mala sala " * 5), ("bb", "quick brown thing " * 5)] * 30
    model = fit_rows(rows, np.ones(BUCKETS))
    assert (model.table != 0).mean() < 0.01 and model.temperature > 0
    assert model.predict("kala mala")[0] == "aa" and model.predict("brown thing")[0] == "bb"


def test_edges(spark):
    rows = [
        (1, "en", "the house and the garden " * 9, 0), (2, "de", "das haus und der garten " * 9, 0), (3, None, "the garden", 0),
        (4, "en", None, 0), (5, "en", "", 0), (6, "de", "123 ... !?", 0), (None, "en", "the house", 0), (7, "xx", "the " * 90000, 0),
        (1, "en", "the house and the garden " * 9, 0),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string, score int").repartition(3)
    found = identify(docs, fit(docs), ["doc_id"]).collect()
    assert len(found) == len(rows)
    by = {r["doc_id"]: r for r in found}
    assert by[4]["lang_pred"] == by[5]["lang_pred"] == by[6]["lang_pred"] == UNDETERMINED and by[4]["score"] == 0
    assert by[2]["lang_pred"] == "de" and by[1]["lang_pred"] in ("en", "xx")
    none = docs.limit(0)
    assert identify(none, fit(none), ["doc_id"]).count() == 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in identify(unlabelled, fit(unlabelled), ["doc_id"]).collect()} == {UNDETERMINED}


def test_every_label_is_learned(spark, monkeypatch):
    rows = [(100 * k + d, chr(0x4E00 + 40 * k + d) * 3 + chr(0x4E00 + 40 * k) * 9, f"l{k:02}") for k in range(70) for d in range(4 if k < 64 else 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert fit(docs).languages == [f"l{k:02}" for k in range(70)]
    monkeypatch.setattr("clausemill.llm.language.ALL_FIT_ROWS", 70)
    assert fit(docs).languages == [f"l{k:02}" for k in range(70)]
