import pytest
from pyspark.sql import functions as F

from clausemill.sources.tables import Store


def tables(spark):
    docs = spark.range(200).select(
        F.col("id").alias("doc_id"), (F.col("id") % 4 == 0).alias("is_sample"), F.lit("parsed").alias("status"),
        F.timestamp_seconds(F.col("id") * 3600).alias("expires_at"),
    )
    chunks = spark.range(600).select((F.col("id") % 200).alias("doc_id"), F.col("id").alias("chunk_id"))
    return docs, chunks


@pytest.fixture
def held(spark, tmp_path):
    out = Store(spark, str(tmp_path / "store"), buckets=16)
    docs, chunks = tables(spark)
    out.create("load", documents=docs, chunks=chunks)
    return out


def ids(spark, *numbers):
    return spark.createDataFrame([(n,) for n in numbers], "doc_id long")


def test_a_delete_cascades_and_spares_samples(spark, held):
    assert held.delete("d1", ids(spark, 1, 2, 4, 999, 1)) == {"documents": 2, "chunks": 6}
    left = {r["doc_id"] for r in held.read("documents").collect()}
    assert left == set(range(200)) - {1, 2} and held.read("chunks").count() == 594


def test_a_retry_changes_nothing_more(spark, held):
    assert held.delete("d1", ids(spark, 1)) == held.delete("d1", ids(spark, 1, 2)) == {"documents": 1, "chunks": 3}
    assert held.read("documents").count() == 199


def test_only_touched_buckets_are_rewritten(spark, held):
    before = held.snapshot().buckets
    held.delete("d1", ids(spark, 1))
    after = held.snapshot().buckets
    for name in before:
        assert sum(after[name].get(b) != v for b, v in before[name].items()) <= 1
    assert held.delete("d2", ids(spark, 999)) == {"documents": 0, "chunks": 0} and held.snapshot().buckets == after


def test_a_change_that_broke_off_before_its_commit_is_not_seen(spark, held, monkeypatch):
    def fail(now):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(held, "_commit", fail)
        with pytest.raises(RuntimeError):
            held.delete("d1", ids(spark, 1, 2, 3))
    assert held.read("documents").count() == 200 and held.read("chunks").count() == 600
    assert held.delete("d1", ids(spark, 3)) == {"documents": 1, "chunks": 3}
    assert held.read("documents").count() == 199 and held.read("chunks").count() == 597


def test_purge_and_write_back(spark, held):
    assert held.purge("p", F.lit("1970-01-02 00:00:00").cast("timestamp")) == {"documents": 18, "chunks": 54}
    updates = spark.createDataFrame([(30, "embedded"), (31, None), (0, "embedded"), (5, "embedded")], "doc_id long, status string")
    assert held.write_back("w", updates, ["status"]) == 3  # 5 was purged
    assert {r["doc_id"] for r in held.read("documents").filter("status = 'embedded'").collect()} == {0, 30}
    assert held.read("documents").count() == 182


def test_added_twice_is_there_once(spark, held):
    docs, chunks = tables(spark)
    more = docs.filter("doc_id < 10").withColumn("doc_id", F.col("doc_id") + 195)
    some = more.select("doc_id", F.lit(7).cast("long").alias("chunk_id"))
    assert held.add("a1", documents=more, chunks=some) == {"documents": 5, "chunks": 5}
    assert held.add("a2", documents=more, chunks=some) == {"documents": 0, "chunks": 0}
    assert held.read("documents").count() == 205


def test_all_rows_may_go(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), buckets=4)
    assert store.snapshot().version == 0
    docs, _ = tables(spark)
    store.create("load", documents=docs.filter("doc_id = 1"))
    assert store.delete("d", ids(spark, 1)) == {"documents": 1}
    assert store.read("documents").count() == 0 and store.read("documents").columns == docs.columns
    store.create("again", documents=docs.limit(0))
    assert store.read("documents").count() == 0
