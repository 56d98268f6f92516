"""Queries and vectors meet as blocks and shelves, and find what pairs of rows would."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausemill.functions import vectors as V
from __spark_entry__ import QUERIES
from clausemill.operators import cells, retrieval
from clausemill.operators.retrieval import top_k

FOLDER = "/root/testdata/sf0.001"


def by_pairs(assigned, asked, index, k):
    pairs = cells.candidates(assigned, asked, index, k)
    measured = pairs.select("query_id", "chunk_id", "chunk_index", V.cosine_distance(F.col("vector"), F.col("embedding")).alias("distance"))
    return top_k(measured, ["query_id"], [F.asc_nulls_last("distance"), F.asc("chunk_index")], k)


def odd_rows():
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=4).round(1)]) for i in range(150)]
    rows += [(200 + i, rows[5][1]) for i in range(40)] + [(5, rows[5][1]), (300, [0.0] * 4), (301, [0.0] * 4), (302, None), (303, [1.0])]
    return rows + [(None, rows[7][1]), (304, [2 * x for x in rows[5][1]]), (305, [float("nan")] * 4)]


@pytest.mark.parametrize("k", [1, 6, 500])
def test_blocks_and_shelves_find_the_same(spark, monkeypatch, k):
    monkeypatch.setattr(cells, "SHELF", 16)
    monkeypatch.setattr(cells, "BLOCK", 20)
    monkeypatch.setattr(cells, "SLICE", 7)
    held = spark.createDataFrame([(i, i, v) for i, v in odd_rows()], "chunk_id long, chunk_index long, embedding array<float>")
    asked = spark.createDataFrame(odd_rows()[::3] + odd_rows()[150:], "query_id long, vector array<float>")
    index = cells.fit(held.filter("chunk_id < 150"), 3)
    assigned = cells.assign(held, index)
    expected = by_pairs(assigned, asked, index, k)
    assert sorted(map(str, cells.search(assigned, asked, index, k).collect())) == sorted(map(str, expected.collect()))


def test_shelves_hold_bounded_parts_of_cells():
    sizes = np.array([0, cells.SHELF, 5, cells.SHELF - 6, 2, 2 * cells.SHELF + 9, 1])
    first, count = cells._shelves(sizes)
    assert first.tolist() == [0, 0, 1, 1, 2, 3, 6] and count.tolist() == [1, 1, 1, 1, 1, 3, 1]


def test_pairs_are_not_rows(spark):
    held = spark.createDataFrame([(i, i, [1.0, float(i)]) for i in range(30)], "chunk_id long, chunk_index long, embedding array<float>")
    asked = held.select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"))
    index = cells.fit(held, 3)
    plan = cells.search(cells.assign(held, index), asked, index, 3)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Join" not in plan


@pytest.mark.parametrize("k", [1, 6, 500])
def test_all_distances_as_matrices(spark, monkeypatch, k):
    """Several scopes, vectors and queries of several sizes, null, empty and without a direction, repeated keys."""
    monkeypatch.setattr(cells, "SHELF", 16)
    monkeypatch.setattr(cells, "BLOCK", 20)
    monkeypatch.setattr(cells, "SLICE", 7)
    odd = [(306, []), (307, [1.0, 2.0]), (308, [2.0, 1.0]), (308, [2.0, 1.0])]
    held = [(i % 3 if i and i % 7 else None if i is None else 0, i, i, v) for i, v in odd_rows() + odd]
    held = spark.createDataFrame(held, "doc_id long, chunk_id long, chunk_index long, embedding array<float>")
    asked = [(None if i == 5 else (i or 0) % 4, i, v) for i, v in odd_rows()[::3] + odd_rows()[150:] + odd]
    asked = spark.createDataFrame(asked, "doc_id long, query_id long, vector array<float>")
    expected = retrieval.vector_search(held, asked, k)
    got = retrieval.vector_search(held, asked, k, large=True)
    columns = ["query_id", "chunk_id", "chunk_index", "distance", "rank"]
    if k > 200:  # all are found
        assert got.count() == expected.count()
    form = lambda found: sorted(map(str, found.select("query_id", "chunk_index", "distance", "rank").collect()))
    assert form(got) == form(expected) and got.columns == columns


def test_pairs_are_counted_by_cell(spark):
    held = spark.createDataFrame([(i, i, v) for i, v in odd_rows()], "chunk_id long, chunk_index long, embedding array<float>")
    asked = held.select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"))
    index = cells.fit(held.filter("chunk_id < 150"), 3)
    assigned = cells.assign(held, index)
    counted = cells.candidates(assigned, asked, index, 3, counted=True)
    assert counted.agg(F.sum("pairs")).first()[0] == cells.candidates(assigned, asked, index, 3).count()


def test_ground_truth_is_not_made_of_pairs(spark, monkeypatch):
    """The query's exact neighbours meet as matrices and its candidates are counted before they meet."""
    plans = []
    recall = retrieval.recall_against
    monkeypatch.setattr(retrieval, "recall_against", lambda exact, found: plans.append(exact._jdf.queryExecution().executedPlan().toString()) or recall(exact, found))
    [row] = QUERIES["cell_recall_r6"](spark, FOLDER).collect()
    assert row["nine_in_ten"] and row["fewer_distances"] and row["expected"] > 0
    assert "FlatMapCoGroupsInArrow" in plans[0] and "cosine_distance" not in plans[0]
