from pyspark.sql import functions as F

from clausemill import schemas
from clausemill.plans.ingest import ingest
from clausemill.sources import store
from clausemill.streaming import uploads

PAGES = [("a", 1, "SECTION 1: TERMS OF USE\nWrite to me@x.example.com for the whole text of it."), ("b", 1, "Plain text that is long enough to count as a page.")]


def test_write_read_delete_and_purge(spark, tmp_path):
    done = ingest(spark.createDataFrame(PAGES, schemas.PAGES))
    created = F.lit("2024-01-01 00:00:00").cast("timestamp")
    docs = store.document_rows(done.documents.drop("chunk_count"), done.chunks, created).withColumn("is_sample", F.col("doc_id") == "b")
    unfinished = done.chunks.withColumn("doc_id", F.lit("zz"))
    unfinished.write.parquet(str(tmp_path / "s" / "chunks" / "load_id=two"))
    done.chunks.write.parquet(str(tmp_path / "s" / "chunks" / "load_id=one"))  # an attempt that ended before its documents
    for _ in range(2):
        store.write_documents(docs, done.chunks, str(tmp_path / "s"), "one")
    documents, chunks = store.read_documents(spark, str(tmp_path / "s"))
    assert chunks.count() == done.chunks.count() and documents.count() == docs.count()
    left, kept = store.delete_documents(spark.createDataFrame([("a",), ("b",)], "doc_id string"), documents, chunks)
    assert [r.doc_id for r in left.collect()] == ["b"] and {r.doc_id for r in kept.collect()} == {"b"}
    day = F.lit("2024-01-02 00:00:00").cast("timestamp")
    assert store.expired(documents, day).count() == 0
    assert [r.doc_id for r in store.expired(documents, day + F.expr("INTERVAL 1 SECOND")).collect()] == ["a"]


def test_fixture_round_trip(spark, tmp_path):
    cache = spark.createDataFrame([("k1", "m", [0.1234567, 1.0]), ("k2", "m", [0.5, 0.25])], schemas.EMBEDDING_CACHE)
    path = str(tmp_path / "fixture")
    assert store.import_fixture(cache, path).count() == 2
    store.export_fixture(cache, path)
    partial = cache.filter("content_hash = 'k2'")
    got = {r.content_hash: [round(x, 6) for x in r.embedding] for r in store.import_fixture(partial, path).collect()}
    assert got == {"k1": [0.123457, 1.0], "k2": [0.5, 0.25]}


def test_stream_equals_batch_and_replays_are_harmless(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    for i, page in enumerate(PAGES):
        spark.createDataFrame([page], schemas.PAGES).coalesce(1).write.mode("append").parquet(source)
    for state in ("state1", "state2"):
        uploads.ingest_uploads(spark, source, target, str(tmp_path / state), files_per_batch=1).awaitTermination()
    batch = ingest(spark.createDataFrame(PAGES, schemas.PAGES))
    for name, want in (("documents", batch.documents), ("chunks", batch.chunks), ("pii_map", batch.pii_map)):
        got = spark.read.parquet(f"{target}/{name}").drop("batch")
        assert sorted(map(repr, got.select(*sorted(want.columns)).collect())) == sorted(map(repr, want.select(*sorted(want.columns)).collect()))


def test_embedding_stream_reuses_earlier_batches(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    for i, text in enumerate(["alpha beta", "alpha beta", "gamma delta"]):
        row = (f"c{i}", "d", i, 1, 1, None, text, 3)
        spark.createDataFrame([row], schemas.CHUNKS).coalesce(1).write.mode("append").parquet(source)
    uploads.embed_chunks(spark, source, target, str(tmp_path / "state"), 16, files_per_batch=1).awaitTermination()
    assert spark.read.parquet(f"{target}/cache").count() == 2
    done = spark.read.parquet(f"{target}/chunks")
    assert done.count() == 3 and done.filter("size(embedding) = 16").count() == 3


def test_document_may_hold_most_rows(spark):
    """One document far over the page limit is rejected whole before anything is gathered per document."""
    hot = spark.range(3000).select(F.lit("hot").alias("doc_id"), (F.col("id") + 1).cast("int").alias("page"), F.lit("x" * 40).alias("text"))
    rest = spark.createDataFrame(PAGES, schemas.PAGES)
    done = ingest(hot.unionByName(rest))
    assert {(r.doc_id, r.reject) for r in done.rejects.collect()} == {("hot", "TOO_MANY_PAGES")}
    assert {r.doc_id for r in done.documents.collect()} == {"a", "b"}


def test_uploads_without_pages_are_rejected(spark):
    files = [("a", "a.pdf", "application/pdf"), ("b", "b.pdf", "application/pdf"), ("c", "c.docx", "application/vnd.openxmlformats-officedocument.wordprocessingml.document"), ("d", "d.exe", "application/octet-stream")]
    done = ingest(spark.createDataFrame(PAGES[:1], schemas.PAGES), spark.createDataFrame(files, "doc_id string, file_name string, mime_type string"))
    assert [r.doc_id for r in done.documents.collect()] == ["a"]
    codes = {r.doc_id: r.reject for r in done.rejects.collect()}
    assert set(codes) == {"b", "c", "d"} and codes["b"] == "SCANNED_PDF" and codes["c"] == "EMPTY_DOCUMENT"
