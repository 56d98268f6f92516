from pyspark.sql import functions as F

from clausemill.plans import evaluate
from clausemill.plans.samples import empty_store, load_samples
from clausemill.sources.tables import Store

TEXT = "ARTICLE I\nThe borrower {n} of {mail} shall repay the loan amount with interest on the due date each month.\nSECTION 2: FEES\nA processing fee applies to every loan and is deducted upon disbursement."


def corpus(spark, count):
    rows = [(d, page, TEXT.format(n=d, mail=f"person{d}@mail.example.com")) for d in range(count) for page in (1, 2)]
    pages = spark.createDataFrame(rows, "doc_id long, page int, text string")
    index = spark.createDataFrame([(d, f"s{d}", f"Sample {d}") for d in range(count)], "doc_id long, slug string, title string")
    return index, pages


def test_a_load_may_be_repeated(spark, tmp_path):
    index, pages = corpus(spark, 6)
    created = F.lit("2024-01-02 00:00:00").cast("timestamp")
    held = Store(spark, str(tmp_path / "store"), buckets=2)
    empty_store(held, pages, created)

    def state(done):
        chunks = sorted((r["doc_id"], r["chunk_index"], r["content"]) for r in done.chunks.collect())
        names = sorted((r["doc_id"], r["placeholder"], r["original"]) for r in done.pii_map.collect())
        return sorted((r["doc_id"], r["sample_slug"], r["title"]) for r in done.documents.collect()), chunks, names

    first = load_samples(held, index.filter("doc_id < 2"), pages, "one", created)
    assert first.added["documents"] == 2 and len(state(first)[0]) == 2
    whole = load_samples(held, index, pages, "two", created)
    assert whole.added["documents"] == 4
    again = load_samples(held, index, pages, "three", created)
    assert again.added == {"documents": 0, "chunks": 0} and state(again) == state(whole)
    documents, chunks, names = state(again)
    assert documents == [(d, f"s{d}", f"Sample {d}") for d in range(6)]
    assert [n[2] for n in names] == [f"person{d}@mail.example.com" for d in range(6)]
    assert not any("@" in c[2] for c in chunks) and held.read("documents").count() == 6


def test_every_cap_is_scored_by_its_own_chunks(spark):
    _, pages = corpus(spark, 4)
    asked = spark.createDataFrame([(f"q{d}", d, "processing fee deducted", [2]) for d in range(4)], "query_id string, doc_id long, question string, pages array<int>")
    got = {r["max_tokens"]: r for r in evaluate.chunk_size_scores(pages, asked, 32, sizes=(20, 400)).collect()}
    assert set(got) == {20, 400} and all(r["documents"] == 4 and r["recall_8"] == 1.0 for r in got.values())
    assert got[20]["mean_chunks"] > got[400]["mean_chunks"] and 0 < got[20]["mrr"] <= 1
