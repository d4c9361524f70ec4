"""Fewer dimensions for vectors, by randomised singular values or principal components.

Rows stay where they are. A pass multiplies them by a small matrix that every task has and adds up products of
the width of that matrix; only such sums, of size dimensions x wanted, reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Numbers of a driver's matrix at most (dimensions x wanted): 400 MB.
MOST = 50_000_000


def _sparse_rows(batch: pa.RecordBatch, width: int):
    """A batch of (indices, values) or of whole vectors as (row of each number, place, number, rows)."""
    if batch.num_columns == 2:
        off = np.asarray(batch.column(0).offsets)
        at, x = np.asarray(batch.column(0).flatten()), np.asarray(batch.column(1).flatten())
    else:
        off = np.asarray(batch.column(0).offsets)
        x = np.asarray(batch.column(0).flatten())
        at = np.arange(len(x)) - np.repeat(off[:-1] - off[0], np.diff(off))
    row = np.repeat(np.arange(len(batch)), np.diff(off))
    if len(at) and (at.min() < 0 or at.max() >= width):
        raise ValueError(f"a vector has a place beyond {width}")
    return row, at, x.astype(np.float64), len(batch)


def _times(batch, matrix: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Rows of a batch, less the centre, times a matrix."""
    row, at, x, n = _sparse_rows(batch, len(matrix))
    out = np.zeros((n, matrix.shape[1]))
    if batch.num_columns == 1 and n and len(x) == n * len(matrix):
        out += x.reshape(n, -1) @ matrix
    else:
        np.add.at(out, row, x[:, None] * matrix[at])
    return out - centre @ matrix


def _summed(rows: DataFrame, partial: Callable, shape: tuple[int, int]) -> np.ndarray:
    """The sum over all partitions of a matrix that ``partial`` makes of each batch; sums meet in a tree of tasks."""
    def run(batches):
        total = np.zeros(shape)
        for b in batches:
            if len(b):
                total += partial(b)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["m"])

    def add(batches):
        total = np.zeros(shape)
        for b in batches:
            for m in b.column(0):
                total += np.frombuffer(m.as_buffer()).reshape(shape)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["m"])

    sums = rows.mapInArrow(run, "m binary").coalesce(64).mapInArrow(add, "m binary")
    return np.sum([np.frombuffer(r.m).reshape(shape) for r in sums.toLocalIterator()], axis=0)


def singular_vectors(rows: DataFrame, width: int, wanted: int, centred: bool = False, extra: int = 10, rounds: int = 3, seed: int = 42) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, right vectors as columns, centre) of the matrix whose rows are ``rows``: one column of vectors, or indices and values.

    A random matrix of ``wanted + extra`` columns finds the range: its image under the rows' Gram matrix is made orthogonal and
    mapped again, ``rounds`` times, one pass each. Then the Gram matrix in that basis is small and solved exactly.
    """
    size = min(width, wanted + extra)
    if width * size > MOST:
        raise ValueError(f"{width} dimensions by {size} are more than {MOST} numbers")
    centre = np.zeros(width)
    if centred:
        n = rows.count()

        def column_sums(b):
            out = np.zeros((1, width))
            _, at, x, _ = _sparse_rows(b, width)
            np.add.at(out[0], at, x)
            return out

        centre = _summed(rows, column_sums, (1, width))[0] / max(n, 1)

    def gram(basis):
        def partial(b):
            row, at, x, _ = _sparse_rows(b, width)
            y = _times(b, basis, centre)
            out = np.zeros((width, basis.shape[1]))
            if b.num_columns == 1 and len(x) == len(b) * width:
                out += x.reshape(len(b), -1).T @ y
            else:
                np.add.at(out, at, x[:, None] * y[row])
            return out - np.outer(centre, y.sum(axis=0))

        return _summed(rows, partial, (width, basis.shape[1]))

    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, size)))[0]
    for _ in range(rounds):
        basis = np.linalg.qr(gram(basis))[0]
    image = gram(basis)
    values, turn = np.linalg.eigh((basis.T @ image + image.T @ basis) / 2)
    order = np.argsort(values)[::-1][:wanted]
    vectors = basis @ turn[:, order]
    vectors *= np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))] < 0, -1.0, 1.0)  # one sign of two
    return np.sqrt(np.maximum(values[order], 0)), vectors, centre


def reduced(df: DataFrame, dims: int, method: str = "svd", vector: str = "embedding", indices: str | None = None, width: int | None = None, out: str = "reduced", seed: int = 42) -> DataFrame:
    """``df`` with ``out``: each vector in the ``dims`` strongest directions, of the vectors (``svd``) or of what they differ from their mean by (``pca``).

    ``vector`` holds arrays of ``width`` numbers (the first one's length, if not given); with ``indices``, it holds the values of sparse vectors at
    those places. Vectors that are null, or hold a null or a number that isn't finite, get null and take no part; no rows
    give no rows. Signs are such that a direction's largest part is positive.
    """
    if method not in ("svd", "pca"):
        raise ValueError("method: svd or pca")
    fine = F.col(vector).isNotNull() & F.forall(vector, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    if indices:
        fine = fine & F.col(indices).isNotNull()
    values = F.col(vector).cast("array<double>")
    rows = df.where(fine).select(*([F.col(indices).cast("array<int>").alias("i")] if indices else []), values.alias("x"))
    if width is None:
        first = rows.select(F.max(F.size("x")) if not indices else F.max(F.array_max("i")) + 1).first()[0]
        width = first or 0
    if not width:
        return df.withColumn(out, F.lit(None).cast("array<double>"))
    _, vectors, centre = singular_vectors(rows, width, min(dims, width), method == "pca", seed=seed)
    shared = df.sparkSession.sparkContext.broadcast((vectors, centre))
    schema = df.drop(out).schema.add(out, T.ArrayType(T.DoubleType()))

    def project(batches):
        vectors, centre = shared.value
        for b in batches:
            *rest, x, i = b.columns
            ok = x.is_valid().to_numpy(zero_copy_only=False)
            low: list = [None] * len(b)
            if ok.any():
                keep = pa.array(ok)
                some = pa.RecordBatch.from_arrays([*([i.filter(keep)] if indices else []), x.filter(keep)], names=["i", "x"][0 if indices else 1 :])
                for k, y in zip(np.flatnonzero(ok), _times(some, vectors, centre)):
                    low[k] = y
            yield pa.RecordBatch.from_arrays([*rest, pa.array(low, pa.list_(pa.float64()))], names=schema.names)

    places = F.col(indices).cast("array<int>") if indices else F.lit(None).cast("array<int>")
    return df.drop(out).select("*", F.when(fine, values).alias("__x"), places.alias("__i")).mapInArrow(project, schema)
