"""Approximate vector search over a whole corpus: cells of a coarse quantiser, several cells per query, exact distances.

The cells are fitted to a bounded sample; every vector is assigned to its nearest cell. How many cells a query looks into
is measured on the sample, so that it finds the wanted share of the true neighbours there, and it goes on to further
cells until they hold enough vectors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors as V
from .retrieval import top_k

#: Cells at most, sampled vectors for each, bytes of the sample at most: the bound of what the driver fits.
MAX_CELLS, PER_CELL, SAMPLE_BYTES = 4096, 64, 64 << 20
ROUNDS = 8
#: Sampled vectors that are asked for their neighbours among the sample, and the share of those that must be in the cells.
ASKED, WANTED = 256, 0.96
#: Vectors on a shelf and queries in a block, which meet as two matrices; rows of a block that are measured at once.
SHELF, BLOCK, SLICE = 16384, 4096, 256
#: Distances that are nearer than this may change places when they are rounded.
NEAR = 4e-12
#: Above all distances: vectors without one come last, by their place.
LAST = 1e100


@dataclass(frozen=True)
class Cells:
    """Centres (one per row) and how many of them a query looks into."""

    centres: np.ndarray
    probes: int


def _unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.sqrt((matrix * matrix).sum(1, keepdims=True))
    return matrix / np.where(norms == 0, 1.0, norms)


def _order(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Of unit vectors, how far each is from each centre, up to what is the same for all centres."""
    return (centres * centres).sum(1) - 2.0 * rows @ centres.T


def fit(chunks: DataFrame, k: int, key: str = "chunk_id", embedding: str = "embedding", cells: int | None = None) -> Cells | None:
    """Cells for the vectors of ``embedding``, null ones left out; None without any.

    The sample is the ``PER_CELL`` vectors per cell with the smallest hash of ``key`` (fewer if they are more than
    ``SAMPLE_BYTES``); of vectors of several sizes only those of the first one's size are indexed.
    """
    held = chunks.filter(F.size(embedding) > 0)
    total = held.count()
    if not total:
        return None
    cells = cells or min(MAX_CELLS, max(1, round(total**0.5)))
    drawn = held.select(F.xxhash64(F.col(key).cast("string")).alias("h"), F.col(embedding).alias("v")).orderBy("h", "v")
    size = len(drawn.first()["v"])
    limit = max(cells, min(cells * PER_CELL, SAMPLE_BYTES // (8 * size)))
    sample = np.array([r["v"] for r in drawn.filter(F.size("v") == size).limit(limit).collect()], np.float64).reshape(-1, size)
    rows = _unit(sample)
    centres = rows[:cells].copy()
    for _ in range(ROUNDS):
        nearest = _order(rows, centres).argmin(1)
        counts = np.bincount(nearest, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, rows)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    nearest = _order(rows, centres).argmin(1)
    asked = rows[-ASKED:]
    distance = 1.0 - asked @ rows.T
    distance[np.arange(len(asked)), np.arange(len(rows) - len(asked), len(rows))] = np.inf
    true = np.argsort(distance, axis=1, kind="stable")[:, : min(k, len(rows) - 1)]
    place = np.argsort(np.argsort(_order(asked, centres), axis=1, kind="stable"), axis=1, kind="stable")
    needed = np.sort(np.take_along_axis(place, nearest[true], axis=1).ravel())
    probes = 1 + int(needed[min(len(needed) - 1, int(np.ceil(WANTED * len(needed))))]) if len(needed) else 1
    return Cells(centres.astype(np.float32), probes)


def cells_of(vector: Column, cells: Cells, sizes: np.ndarray | None = None, least: int = 0) -> Column:
    """The nearest cell of a vector, in an array; with ``sizes`` the cells a query looks into, nearest first.

    Null vectors and those of another size have none.
    """
    centres, probes = cells.centres, cells.probes

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def look_up(vectors: pa.Array) -> pa.Array:
        found = pa.compute.fill_null(pa.compute.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(found == centres.shape[1])
        values = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, centres.shape[1]).astype(np.float64)
        far = _order(_unit(values), centres.astype(np.float64))
        out: list[list[int]] = [[] for _ in range(len(vectors))]
        if sizes is None:
            for i, cell in zip(at.tolist(), far.argmin(1).tolist()):
                out[i] = [cell]
        else:
            order = np.argsort(far, axis=1, kind="stable")
            enough = (np.cumsum(sizes[order], axis=1) < least).sum(1) + 1
            for i, row, n in zip(at.tolist(), order, np.maximum(enough, probes).tolist()):
                out[i] = row[:n].tolist()
        return pa.array(out, pa.list_(pa.int32()))

    return look_up(vector)


def assign(chunks: DataFrame, cells: Cells, embedding: str = "embedding") -> DataFrame:
    """``chunks`` that can be found, with their ``cell``: store them by it."""
    return chunks.withColumn("cell", F.get(cells_of(F.col(embedding), cells), 0)).filter("cell IS NOT NULL")


def _sizes(assigned: DataFrame, cells: Cells) -> np.ndarray:
    sizes = np.zeros(len(cells.centres), np.int64)
    for row in assigned.groupBy("cell").count().collect():  # a row per cell
        sizes[row["cell"]] = row["count"]
    return sizes


def candidates(assigned: DataFrame, queries: DataFrame, cells: Cells, k: int, counted: bool = False) -> DataFrame:
    """``query_id``, ``vector`` and the vectors of the cells each query looks into; ``counted`` instead ``cell`` and how many
    ``pairs`` a cell gives, as queries and vectors that are counted before they meet: pairs grow with the square of the table."""
    sizes = _sizes(assigned, cells)
    asked = queries.select("query_id", "vector", F.explode(cells_of(F.col("vector"), cells, sizes=sizes, least=k)).alias("cell"))
    if counted:
        both = asked.groupBy("cell").agg(F.count("*").alias("asked")).join(assigned.groupBy("cell").agg(F.count("*").alias("held")), "cell")
        return both.select("cell", (F.col("asked") * F.col("held")).alias("pairs"))
    return asked.join(assigned.select("cell", "chunk_id", "chunk_index", "embedding"), "cell")


def _shelves(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first shelf of every cell and on how many shelves it lies: small cells share one, large ones have several."""
    first, count, at, held = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64), 0, 0
    for cell, size in enumerate(sizes.tolist()):
        if held and held + size > SHELF:
            at, held = at + 1, 0
        first[cell], count[cell] = at, max(1, -(-size // SHELF))
        at, held = at + count[cell] - 1, held + size if count[cell] == 1 else SHELF
    return first, count


def _by_shelf(looked: Column, first: np.ndarray, count: np.ndarray) -> Column:
    """The cells a query looks into, as a list of shelves with those of their cells."""

    @F.arrow_udf(T.ArrayType(T.StructType().add("shelf", T.LongType()).add("cells", T.ArrayType(T.IntegerType()))))
    def dealt(lists: pa.Array) -> pa.Array:
        out = []
        for row in lists.to_pylist():
            found: dict[int, list[int]] = {}
            for cell in row:
                for shelf in range(first[cell], first[cell] + count[cell]):
                    found.setdefault(shelf, []).append(cell)
            out.append([{"shelf": shelf, "cells": held} for shelf, held in found.items()])
        return pa.array(out, pa.list_(pa.struct([("shelf", pa.int64()), ("cells", pa.list_(pa.int32()))])))

    return dealt(looked)


def _matrix(vectors: pa.ChunkedArray, rows: int) -> np.ndarray:
    flat = vectors.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(rows, -1).astype(np.float64)


def _once(values: np.ndarray, cell: np.ndarray, k: int) -> np.ndarray:
    """Of rows in order, those that are not preceded by ``k`` equal ones: no further one can be among the ``k`` nearest."""
    same = np.unique(np.ascontiguousarray(values).view(np.dtype((np.void, values.shape[1] * values.itemsize))).ravel(), return_inverse=True)[1]
    order = np.lexsort((cell, same))
    starts = np.r_[True, (np.diff(same[order]) != 0) | (np.diff(cell[order]) != 0)]
    place = np.arange(len(order)) - np.maximum.accumulate(np.where(starts, np.arange(len(order)), 0))
    return np.sort(order[place < k])


def nearest(asked: pa.Table, held: pa.Table, k: int) -> pa.Table:
    """The ``k`` nearest vectors of a shelf for each query of a block, of those in the query's cells.

    One product of two matrices gives all distances nearly; what may be among the ``k`` nearest is measured exactly.
    """
    empty = pa.table([asked["query_id"].slice(0, 0), held["chunk_id"].slice(0, 0), held["chunk_index"].slice(0, 0), pa.array([], pa.float64())], ["query_id", "chunk_id", "chunk_index", "distance"])
    if not asked.num_rows or not held.num_rows:
        return empty
    held = held.sort_by("chunk_index")
    nulls = held["chunk_index"].null_count  # last here, first in the ranking
    held = pa.concat_tables([held.slice(held.num_rows - nulls), held.slice(0, held.num_rows - nulls)]) if nulls else held
    values, cell = _matrix(held["embedding"], held.num_rows), held["cell"].to_numpy()
    kept = _once(values, cell, k)
    held, values, cell = held.take(pa.array(kept)), values[kept], cell[kept]
    questions = _matrix(asked["vector"], asked.num_rows)
    # equal chunk indexes have one place
    place = np.unique(np.array([(0, 0) if i is None else (1, i) for i in held["chunk_index"].to_pylist()]), axis=0, return_inverse=True)[1].ravel()
    last, undirected = LAST * (1.0 + place / (1 + len(place))), ~(np.abs(values).sum(1) > 0)
    unit, in_cell = _unit(values), {int(c): np.flatnonzero(cell == c) for c in np.unique(cell)}
    parts = []
    for begin in range(0, len(questions), SLICE):
        x = questions[begin : begin + SLICE]
        about = np.where(undirected, last, 1.0 - _unit(x) @ unit.T)
        about = np.where(np.isnan(about) | ~(np.abs(x).sum(1) > 0)[:, None], last, about)
        looked = np.zeros((len(x), int(cell.max()) + 1), bool)
        lists = asked["cells"].slice(begin, SLICE).combine_chunks()
        at, which = np.repeat(np.arange(len(x)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()
        inside = which < looked.shape[1]
        looked[at[inside], which[inside]] = True
        for c, columns in in_cell.items():
            about[np.ix_(~looked[:, c], columns)] = np.inf
        bound = np.partition(about, k - 1, axis=1)[:, k - 1] if k < about.shape[1] else np.full(len(x), LAST * 3)
        row, column = np.nonzero((about <= bound[:, None] + NEAR) & np.isfinite(about))
        distance = V.distances(x[row], values[column])
        order = np.lexsort((place[column], np.where(np.isnan(distance), np.inf, distance), row))
        row, column, distance = row[order], column[order], distance[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        parts.append((row[rank < k] + begin, column[rank < k], distance[rank < k]))
    row, column, distance = (np.concatenate(x) for x in zip(*parts))
    found = held.take(pa.array(column))
    return pa.table(
        [asked["query_id"].take(pa.array(row)), found["chunk_id"], found["chunk_index"], pa.array(distance, mask=np.isnan(distance))], empty.column_names
    )


def search(assigned: DataFrame, queries: DataFrame, cells: Cells, k: int) -> DataFrame:
    """The ``k`` nearest of the vectors in the cells that each query looks into: ``query_id``, ``chunk_id``,
    ``chunk_index``, ``distance``, ``rank``. The scope is the whole table, for every query.

    Vectors lie on shelves of about ``SHELF``, by cell, queries in blocks of about ``BLOCK``. Every block meets every shelf
    that its queries look into in one task, where the distances are products of matrices; ``k`` rows per query and shelf
    leave it. So pairs are not rows, and memory is bounded by a block and a shelf.
    """
    sizes = _sizes(assigned, cells)
    first, count = _shelves(sizes)
    blocks = max(1, -(-queries.count() // BLOCK))
    looked = _by_shelf(cells_of(F.col("vector"), cells, sizes=sizes, least=k), first, count)
    asked = queries.select("query_id", "vector", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block"), F.explode(looked).alias("s"))
    asked = asked.select("query_id", "vector", "block", "s.shelf", "s.cells")
    spread = F.pmod(F.xxhash64("chunk_id", "chunk_index"), F.get(F.lit(count.tolist()), F.col("cell")))
    shelf = (F.get(F.lit(first.tolist()), F.col("cell")) + spread).alias("shelf")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block")
    held = assigned.select("cell", "chunk_id", "chunk_index", "embedding", shelf, every)
    types = {f.name: f.dataType for f in [*queries.schema, *assigned.schema]}
    schema = T.StructType([T.StructField(c, types[c]) for c in ("query_id", "chunk_id", "chunk_index")]).add("distance", T.DoubleType())

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        return nearest(left, right, k)

    measured = asked.groupBy("block", "shelf").cogroup(held.groupBy("block", "shelf")).applyInArrow(meet, schema)
    return top_k(measured, ["query_id"], [F.asc_nulls_last("distance"), F.asc("chunk_index")], k)


def _of_width(table: pa.Table, name: str, width: int) -> pa.Table:
    """``table`` with all vectors of one size; of others the distance is unknown, as it is of one without a direction."""
    vectors = table[name].combine_chunks()
    sizes = pa.compute.fill_null(pa.compute.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
    same, matrix = np.flatnonzero(sizes == width), np.zeros((table.num_rows, width))
    if len(same):
        matrix[same] = vectors.take(pa.array(same)).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    offsets = np.arange(0, table.num_rows * width + 1, width, dtype=np.int32)
    return table.set_column(table.column_names.index(name), name, pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.ravel())))


def nearest_of_all(asked: pa.Table, held: pa.Table, k: int) -> pa.Table:
    """As :func:`nearest` among all vectors of the shelf, whatever the sizes of the vectors."""
    asked = asked.append_column("cells", pa.array([[0]] * asked.num_rows, pa.list_(pa.int32())))
    held = held.append_column("cell", pa.array(np.zeros(held.num_rows, np.int32)))
    sizes = pa.compute.fill_null(pa.compute.list_value_length(asked["vector"]), 0).to_numpy()
    parts = [
        nearest(_of_width(asked.take(pa.array(np.flatnonzero(sizes == size))), "vector", max(1, size)), _of_width(held, "embedding", max(1, size)), k)
        for size in np.unique(sizes).tolist()
    ]
    return pa.concat_tables(parts) if parts else nearest(asked, held, k)


def search_all(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """What :func:`.retrieval.vector_search` finds, for scopes of many queries and many vectors: ``query_id``, ``chunk_id``,
    ``chunk_index``, ``distance``, ``rank``.

    A scope's vectors are dealt over shelves of about ``SHELF`` and its queries over blocks of about ``BLOCK``. Every block
    meets every shelf of its scope in one task as two matrices, and ``k`` rows per query leave it: all distances are
    measured, but pairs are not rows, and memory is bounded by a block and a shelf.
    """
    held = chunks.filter(F.col("embedding").isNotNull())

    def parts(rows: DataFrame, size: int, name: str) -> DataFrame:
        return rows.groupBy("doc_id").agg(F.ceil(F.count("*") / F.lit(size)).cast("long").alias(name))

    def dealt(key: Column, name: str) -> Column:
        return F.pmod(F.xxhash64(key), F.col(name))

    def every(name: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(name) - 1))

    scopes = parts(queries, BLOCK, "blocks").join(parts(held, SHELF, "shelves"), "doc_id")
    asked = queries.join(scopes, "doc_id").select("doc_id", "query_id", "vector", dealt(F.struct("query_id", "vector"), "blocks").alias("block"), every("shelves").alias("shelf"))
    on_shelf = dealt(F.struct("chunk_id", "chunk_index"), "shelves").alias("shelf")
    found = held.join(scopes, "doc_id").select("doc_id", "chunk_id", "chunk_index", "embedding", on_shelf, every("blocks").alias("block"))
    types = {f.name: f.dataType for f in [*queries.schema, *chunks.schema]}
    schema = T.StructType([T.StructField(c, types[c]) for c in ("query_id", "chunk_id", "chunk_index")]).add("distance", T.DoubleType())

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        return nearest_of_all(left, right, k)

    keys = ["doc_id", "block", "shelf"]
    measured = asked.groupBy(*keys).cogroup(found.groupBy(*keys)).applyInArrow(meet, schema)
    return top_k(measured, ["query_id"], [F.asc_nulls_last("distance"), F.asc("chunk_index")], k)
