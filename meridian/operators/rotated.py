"""Product codes behind a trained rotation, trained on every row of a sample by Spark.

A round is one pass: each task assigns its rows to code words and adds up, for
each chunk and code, how many rows it has and the sum of their whole vectors.
These sums give the new code words in any rotation, and the cross-covariance of
vectors and their decoded forms, whose singular vectors are the best rotation
for the assignment (orthogonal Procrustes). What the driver gets is chunks x
codes x dims numbers, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import as_double
from .kmeans import lloyd, sample_rows
from .knn import ID, VECTOR, _matrix


@dataclass
class Code:
    """A rotation and the code words of each chunk of rotated vectors."""

    rotation: np.ndarray  # [dim, dim]
    books: np.ndarray  # [chunk, code, dim of a chunk]

    def parts(self, x: np.ndarray) -> np.ndarray:
        """[row, chunk, dim of a chunk]"""
        return (x @ self.rotation).reshape(len(x), len(self.books), -1)

    def codes(self, x: np.ndarray) -> np.ndarray:
        """[row, chunk]: the nearest code word, the smaller among equals."""
        y = self.parts(x)
        near = [((book * book).sum(1)[None] - 2 * y[:, c] @ book.T).argmin(1) for c, book in enumerate(self.books)]
        return np.stack(near, 1)

    def decoded(self, codes: np.ndarray) -> np.ndarray:
        """Vectors in the space they were in."""
        y = np.concatenate([self.books[c][codes[:, c]] for c in range(len(self.books))], 1)
        return y @ self.rotation.T


def _pass(vectors: DataFrame, code: Code) -> tuple[np.ndarray, np.ndarray, float, int]:
    """[chunk, code] rows, [chunk, code, dim] sums of vectors, squared error and number of rows."""
    held = vectors.sparkSession.sparkContext.broadcast(code)
    chunks, codes, _ = code.books.shape
    dims = len(code.rotation)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        count, sums, tail = np.zeros((chunks, codes)), np.zeros((chunks, codes, dims)), np.zeros(2)
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                x = _matrix(batch.column(0).slice(i, 4096))
                near = own.codes(x)
                tail += ((x - own.decoded(near)) ** 2).sum(), len(x)
                for c in range(chunks):
                    count[c] += np.bincount(near[:, c], minlength=codes)
                    np.add.at(sums[c], near[:, c], x)
        if tail[1]:
            value = np.concatenate((count.ravel(), sums.ravel(), tail))
            at = np.flatnonzero(value)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(value[at])], ["at", "value"])

    table = vectors.select(as_double(F.col(VECTOR)).alias(VECTOR)).where(F.col(VECTOR).isNotNull()).mapInArrow(run, "at long, value double")
    rows = table.groupBy("at").agg(F.sum("value").alias("value")).toArrow()
    flat = np.zeros(chunks * codes * (dims + 1) + 2)
    flat[rows["at"].to_numpy()] = rows["value"].to_numpy()
    held.unpersist()
    cells = chunks * codes
    return flat[:cells].reshape(chunks, codes), flat[cells:-2].reshape(chunks, codes, dims), float(flat[-2]), int(flat[-1])


def train(vectors: DataFrame, dims: int, chunks: int, codes: int, rounds: int = 8, rotate: bool = True, sample: int = 1 << 20, seed: int = 0) -> Code:
    """Code words, and a rotation unless it is to stay as it is, by turns.

    vectors: vec_id, embedding; residuals of an inverted file, for one. The
    sample is a share of all rows by a hash of their ids; the first code words
    come from a small part of it in memory.
    """
    rows = sample_rows(vectors.select(ID, VECTOR), sample)
    few = sample_rows(rows, 16 * codes).orderBy(F.xxhash64(ID), ID).limit(32 * codes).select(as_double(F.col(VECTOR)).alias(VECTOR)).where(F.col(VECTOR).isNotNull()).toArrow()[VECTOR]
    x = _matrix(few.combine_chunks())
    rotation, k = np.eye(dims), min(codes, len(x))
    code = Code(rotation, np.stack([lloyd(part, k, 4, seed)[0] for part in np.split(x @ rotation, chunks, axis=1)]))
    for _ in range(rounds):
        count, sums, _, _ = _pass(rows, code)
        mean = sums / np.maximum(count, 1)[:, :, None]

        def books(rotation: np.ndarray, mean=mean, count=count, old=code) -> np.ndarray:
            turned = [m @ r for m, r in zip(mean, np.split(rotation, chunks, axis=1), strict=True)]
            # a code word without rows stays where it is
            return np.where(count[:, :, None] > 0, np.stack(turned), old.books)

        new = books(code.rotation)
        if rotate:
            cross = np.concatenate([s.T @ b for s, b in zip(sums, new, strict=True)], 1)
            u, _, vt = np.linalg.svd(cross)
            code = Code(u @ vt, books(u @ vt))
        else:
            code = Code(code.rotation, new)
    return code


def encode(vectors: DataFrame, code: Code) -> DataFrame:
    """vec_id, codes; of a null vector, null."""
    held = vectors.sparkSession.sparkContext.broadcast(code)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            there = batch.filter(batch.column(1).is_valid())
            near = held.value.codes(_matrix(there.column(1))) if there.num_rows else np.empty((0, 0), int)
            yield pa.RecordBatch.from_arrays([there.column(0), pa.array(near.tolist(), pa.list_(pa.int32()))], [ID, "codes"])

    slim = vectors.select(F.col(ID).cast("long").alias(ID), as_double(F.col(VECTOR)).alias(VECTOR))
    coded = slim.mapInArrow(run, f"{ID} long, codes array<int>")
    return coded.unionByName(slim.where(F.col(VECTOR).isNull()).select(ID, F.lit(None).cast("array<int>").alias("codes")))


def error(vectors: DataFrame, code: Code) -> float:
    """Mean squared distance of vectors from their decoded forms."""
    _, _, total, n = _pass(vectors, code)
    return total / max(n, 1)


def book_table(spark, code: Code) -> DataFrame:
    """chunk, code, sub, as the other codes' books are."""
    return spark.createDataFrame([(c, k, w.tolist()) for c, book in enumerate(code.books) for k, w in enumerate(book)], "chunk int, code int, sub array<double>")
