import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalog import retrieval as searches
from clausemill.functions import vectors as V
from clausemill.operators import cells, embedding, retrieval


def test_hash_embedding_properties(spark):
    rows = [("a", "prepayment charge of four percent"), ("b", "charges for prepayment"), ("c", "arbitration in Mumbai"), ("d", "the of and")]
    df = spark.createDataFrame(rows, "id string, t string").select("id", V.hash_embedding(F.col("t"), 768).alias("e"))
    e = {r.id: r.e for r in df.collect()}
    dot = lambda x, y: sum(a * b for a, b in zip(x, y))
    assert all(math.isclose(dot(e[k], e[k]), 1.0, rel_tol=1e-5) for k in "abc")
    assert dot(e["d"], e["d"]) == 0
    assert dot(e["a"], e["b"]) > dot(e["a"], e["c"])


def test_rank_fusion(spark):
    rows = [("q", "vector", x, i + 1, 1.0) for i, x in enumerate("abc")] + [("q", "text", x, i + 1, 1.0) for i, x in enumerate("cad")]
    rows += [("q", "idle", "z", 1, 0.0)]
    df = spark.createDataFrame(rows, "query_id string, source string, id string, rank int, weight double")
    got = retrieval.fused_top_k(df, 10).orderBy("rank").collect()
    assert [r.id for r in got] == ["a", "c", "b", "d"]
    assert math.isclose(got[0].score, 1 / 61 + 1 / 62) and got[0].ranks == {"vector": 1, "text": 2}


def corpus(spark, n=400, dims=32, docs=1):
    rng = random.Random(3)
    rows = [(f"d{i % docs}", f"c{i}", i, [rng.gauss(0, 1) for _ in range(dims)]) for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id string, chunk_id string, chunk_index int, embedding array<float>")


def test_vector_search_against_brute_force(spark):
    rows, chunks = corpus(spark)
    queries = [(f"q{i}", "d0", rows[i][3]) for i in range(5)]
    df = spark.createDataFrame(queries, "query_id string, doc_id string, vector array<float>")
    got = {}
    for r in retrieval.vector_search(chunks, df, 7).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)

    def distance(a, b):
        return 1 - sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))

    for name, _, q in queries:
        want = sorted(rows, key=lambda r: (round(distance(q, r[3]), 6), r[2]))[:7]
        assert got[name] == [r[1] for r in want]


@pytest.mark.parametrize("size", ["0.01", "0.1"])
def test_approximate_search_finds_nine_in_ten_of_the_true_neighbours(spark, size):
    """On the query's own rows: every twentieth of the given vectors against all of them."""
    held, asked, index, assigned = searches._searched(spark, f"/root/testdata/sf{size}")
    k = searches.NEIGHBOURS
    report = retrieval.recall_against(retrieval.vector_search(held, asked, k), cells.search(assigned, asked, index, k)).first()
    pairs = held.count() * asked.count()
    assert report.expected == k * asked.count() and report.recall >= 0.9
    assert cells.candidates(assigned, asked, index, k).count() < 0.85 * pairs


def test_clustered_vectors_need_few_cells(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16))
    rows = [(i, [float(x) for x in centres[i % 40] + rng.normal(scale=0.05, size=16)]) for i in range(1600)]
    held = spark.createDataFrame([(i, i, v) for i, v in rows], "chunk_id long, chunk_index long, embedding array<float>")
    asked = spark.createDataFrame([(i, v) for i, v in rows[::20]] + [(-1, None), (-2, [1.0])], "query_id long, vector array<float>")
    index = cells.fit(held, 5)
    assigned = cells.assign(held, index)
    got = cells.search(assigned, asked, index, 5)
    matrix = np.array([v for _, v in rows])
    matrix /= np.sqrt((matrix * matrix).sum(1, keepdims=True))
    true = {i: set(np.argsort(1 - matrix @ matrix[i], kind="stable")[:5].tolist()) for i, _ in rows[::20]}
    found = [(r["query_id"], r["chunk_id"]) for r in got.collect()]
    assert len(found) == 5 * len(true) and sum(c in true[q] for q, c in found) >= 0.95 * len(found)
    assert cells.candidates(assigned, asked, index, 5).count() < 0.35 * len(rows) * len(true)


def test_cells_go_on_until_there_are_enough_vectors(spark):
    held = spark.createDataFrame([(i, i, [1.0, float(i)]) for i in range(9)] + [(90, 90, None)], "chunk_id long, chunk_index long, embedding array<float>")
    asked = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, vector array<float>")
    index = cells.Cells(cells.fit(held, 2, cells=9).centres, 1)
    assert cells.search(cells.assign(held, index), asked, index, 7).count() == 7
    assert cells.fit(held.limit(0), 3) is None


def test_top_k_is_limited_before_the_shuffle(spark):
    _, chunks = corpus(spark, 50)
    queries = spark.createDataFrame([("q", "d0", [1.0] * 32)], "query_id string, doc_id string, vector array<float>")
    plan = retrieval.vector_search(chunks, queries, 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Cartesian" not in plan and "BroadcastNestedLoop" not in plan


def test_text_search_needs_a_lexeme(spark):
    chunks = spark.createDataFrame(
        [("d", "c0", 0, "Loan charges and loan fees"), ("d", "c1", 1, "Charged a fee"), ("d", "c2", 2, "Nothing else")],
        "doc_id string, chunk_id string, chunk_index int, content string",
    )
    asks = spark.createDataFrame([("q", "d", "loan charges?"), ("r", "d", "the of and")], "query_id string, doc_id string, question string")
    got = [(r.query_id, r.chunk_id, r.score) for r in retrieval.text_search(retrieval.postings(chunks), asks, 5).orderBy("rank").collect()]
    assert got == [("q", "c0", 3), ("q", "c1", 1)]


def test_hybrid_without_lexemes_is_vector_only(spark):
    rows = [("d", "c0", 0, "loan charges"), ("d", "c1", 1, "governing law")]
    chunks = spark.createDataFrame(rows, "doc_id string, chunk_id string, chunk_index int, content string")
    chunks = chunks.withColumn("embedding", V.hash_embedding(F.col("content"), 64))
    asks = spark.createDataFrame([("q", "d", "the of and")], "query_id string, doc_id string, question string")
    asks = asks.withColumn("vector", F.array(*[F.lit(float(i == 0)) for i in range(64)]).cast("array<float>"))
    got = retrieval.hybrid_search(chunks, asks, 2).collect()
    assert len(got) == 2 and all(set(r.ranks) == {"vector"} for r in got)


def test_cache_aside(spark):
    texts = spark.createDataFrame([(1, "alpha beta"), (2, "alpha beta"), (3, "gamma"), (4, "delta")], "id int, content string")
    cache = spark.createDataFrame([], "content_hash string, model string, embedding array<float>")
    first, grown = embedding.embed_rows(texts.filter("id < 4"), cache, 16)
    assert grown.count() == 2
    by_id = {r.id: list(r.embedding) for r in first.collect()}
    assert by_id[1] == by_id[2]
    keyed = embedding.with_keys(texts, embedding.HASH_MODEL, 16, "RETRIEVAL_DOCUMENT", "content")
    assert tuple(embedding.embedding_stats(keyed, grown).first()) == (4, 2, 1)
    assert embedding.missing_keys(keyed, grown, "content").count() == 1


def test_batches_are_dense(spark):
    keyed = spark.range(1000).select(F.sha2(F.col("id").cast("string"), 256).alias("content_hash"), F.lit("t").alias("text"))
    empty = spark.createDataFrame([], "content_hash string, model string, embedding array<float>")
    sizes = embedding.embedding_requests(keyed, empty).groupBy("batch_no").count().orderBy("batch_no").collect()
    assert [r["count"] for r in sizes] == [32] * 31 + [8]


def test_odd_vectors_have_no_distance(spark):
    from clausemill.functions import vectors as V

    pairs = [([1.0, 0.0], [0.0, 2.0]), ([1.0, 0.0], None), (None, None), ([1.0, 0.0], [1.0, 0.0, 0.0]), ([1.0, 0.0, 0.0, 0.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 1.0]), ([], [])]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a array<float>, b array<float>").coalesce(1)
    got = {r.i: r.d for r in rows.select("i", V.cosine_distance(F.col("a"), F.col("b")).alias("d")).collect()}
    assert got == {0: 1.0, 1: None, 2: None, 3: None, 4: None, 5: None, 6: None}
    buckets = {r.i: r.s for r in rows.select("i", V.signatures(F.col("a"), 4, 3).alias("s")).collect()}
    assert buckets[2] is None and buckets[6] is None and len(buckets[4]) == 4 and buckets[0] == buckets[1] == buckets[3]
