"""Embedding vectors: hashing, normalising, similarity, signatures and text form."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import search_tokens


def normalise(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(norm == 0, F.transform(v, lambda x: x.cast("double"))).otherwise(
        F.transform(v, lambda x: x.cast("double") / norm)
    )


def to_literal(v: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: x.cast("string")), ","), F.lit("]"))


def from_literal(s: Column) -> Column:
    return F.from_json(s, "array<float>")


def _signed_slots(words: list[str], dims: int) -> np.ndarray:
    """+(i+1) or -(i+1) for slot i of every word, from its SHA-1: four bytes the slot, the parity of the
    fifth the sign."""
    digests = np.frombuffer(b"".join(hashlib.sha1(w.encode()).digest()[:5] for w in words), np.uint8).reshape(-1, 5)
    slot = digests[:, :4].astype(np.int64) @ np.array([1 << 24, 1 << 16, 1 << 8, 1])
    return np.where(digests[:, 4] % 2 == 0, 1, -1) * (slot % dims + 1)


def _rows(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and row offsets of a list array, without touching single values in Python."""
    array = array.combine_chunks() if isinstance(array, pa.ChunkedArray) else array
    return array.flatten().to_numpy(zero_copy_only=False), array.offsets.to_numpy() - array.offsets[0].as_py()


def _lists(matrix: np.ndarray) -> pa.Array:
    n, d = matrix.shape
    offsets = pa.array(np.arange(0, n * d + 1, d, dtype=np.int32) if d else np.zeros(n + 1, np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(matrix, np.float32).ravel()))


def hash_embedding(text: Column, dims: int = 768) -> Column:
    """Feature-hashed bag of words on the unit sphere.

    Tokens are made in the JVM; a batch hashes each distinct token once and adds up slots in numpy.
    """

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def densify(tokens: pa.Array) -> pa.Array:
        offsets = tokens.offsets.to_numpy() - tokens.offsets[0].as_py()
        words = tokens.flatten().dictionary_encode()
        n = len(offsets) - 1
        signed = _signed_slots(words.dictionary.to_pylist(), dims)
        values = signed[words.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.int64)
        row = np.repeat(np.arange(n), np.diff(offsets))
        dense = np.bincount(row * dims + np.abs(values) - 1, weights=np.sign(values), minlength=n * dims).reshape(n, dims)
        norm = np.sqrt((dense * dense).sum(axis=1, keepdims=True))
        return _lists(dense / np.where(norm == 0, 1.0, norm))

    return densify(search_tokens(text))


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """1 - cos of paired rows, NaN where one has no direction.

    Rounded far below the vectors' own precision, so that equal distances tie whatever the order of the sum.
    """
    norms = np.sqrt((x * x).sum(1) * (y * y).sum(1))
    dots = (x * y).sum(1)
    return np.where(norms == 0, np.nan, np.round(1.0 - dots / np.where(norms == 0, 1.0, norms), 12))


@F.arrow_udf(T.DoubleType())
def cosine_distance(a: pa.Array, b: pa.Array) -> pa.Array:
    """The distance of paired vectors; null where one is null, their sizes differ or either has no direction."""
    sizes = [pa.compute.fill_null(pa.compute.list_value_length(v), -1).to_numpy(zero_copy_only=False) for v in (a, b)]
    same = (sizes[0] == sizes[1]) & (sizes[0] > 0)
    distance = np.full(len(a), np.nan)
    for width in np.unique(sizes[0][same]):
        at = np.flatnonzero(same & (sizes[0] == width))
        distance[at] = distances(*(_rows(v.take(pa.array(at)))[0].reshape(len(at), width).astype(np.float64) for v in (a, b)))
    return pa.array(distance, mask=np.isnan(distance))


def plane_signs(width: int, tables: int, bits: int) -> np.ndarray:
    """Random planes that SQL can repeat: +1 or -1 per slot, table and bit, by the first digit of a digest of the three."""
    names = [[f"{t}/{b}/{slot}" for t in range(tables) for b in range(bits)] for slot in range(width)]
    return np.array([[1.0 if hashlib.md5(n.encode()).hexdigest()[0] < "8" else -1.0 for n in row] for row in names])


def signatures(v: Column, tables: int = 8, bits: int = 6) -> Column:
    """One bucket per table: the sides of ``bits`` planes that the vector lies on; null for a null or empty vector.

    Vectors of each size have planes of their own, so different sizes are not compared. Projections are rounded, so that
    one of zero counts as such whatever the order of its sum.
    """

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def signs(vectors: pa.Array) -> pa.Array:
        sizes = pa.compute.fill_null(pa.compute.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
        buckets = np.zeros((len(vectors), tables), np.int32)
        for width in np.unique(sizes[sizes > 0]):
            at = np.flatnonzero(sizes == width)
            values = _rows(vectors.take(pa.array(at)))[0].reshape(len(at), width).astype(np.float64)
            on = (np.round(values @ plane_signs(int(width), tables, bits), 9) > 0).reshape(len(at), tables, bits)
            buckets[at] = (on * (1 << np.arange(bits))).sum(axis=2)
        starts = pa.array(np.arange(0, len(vectors) * tables + 1, tables, dtype=np.int32))
        return pa.ListArray.from_arrays(starts, pa.array(buckets.ravel()), mask=pa.array(sizes == 0))

    return signs(v)
