"""Additive codes: a vector as a sum of one word of each book, chosen by iterated conditional modes.

What the choice needs of the books are the products of every two words, a table
of (books x words) squared, sent once; of a batch of rows, their products with
all words. A sweep takes the books in turn and gives each row the word that is
best while its other words stay. Sweeps go on until no row changes, so no single
change of a code lowers a row's error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import as_double
from .kmeans import lloyd, sample_rows
from .knn import ID, VECTOR, _matrix


def train_books(vectors: DataFrame, books: int, words: int, sample: int = 16_384, seed: int = 0) -> np.ndarray:
    """[book, word, dim] by k-means of what the books before leave of a bounded sample in memory."""
    few = sample_rows(vectors.select(ID, VECTOR).where(F.col(VECTOR).isNotNull()), sample).orderBy(F.xxhash64(ID), ID).limit(2 * sample)
    rest = _matrix(few.select(as_double(F.col(VECTOR)).alias(VECTOR)).toArrow()[VECTOR].combine_chunks())
    out = []
    for b in range(books):
        centres, label = lloyd(rest, min(words, len(rest)), 5, seed + b)
        out.append(centres)
        rest = rest - centres[label]
    return np.stack(out)


def pair_terms(books: np.ndarray) -> np.ndarray:
    """[book, word, book, word] products of words."""
    return np.einsum("akd,bld->akbl", books, books)


def choose(x: np.ndarray, books: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """[row, book]: codes from book by book, then improved until they are settled."""
    m, k, _ = books.shape
    own = np.einsum("akak->ak", pairs)
    product = np.stack([x @ b.T for b in books], 1)  # [row, book, word]
    codes = np.zeros((len(x), m), np.int64)
    active = np.arange(len(x))

    def best(rows: np.ndarray, b: int, others: list[int]) -> np.ndarray:
        cost = own[b][None] - 2 * product[rows, b]
        for o in others:
            cost = cost + 2 * pairs[b][:, o, :].T[codes[rows, o]]
        return cost

    for b in range(m):
        codes[:, b] = best(active, b, list(range(b))).argmin(1)
    while len(active):
        moved = np.zeros(len(active), bool)
        for b in range(m):
            cost = best(active, b, [o for o in range(m) if o != b])
            now = cost[np.arange(len(active)), codes[active, b]]
            at = cost.argmin(1)
            better = cost[np.arange(len(active)), at] < now - 1e-9 * (1 + np.abs(now))
            codes[active[better], b] = at[better]
            moved |= better
        active = active[moved]
    return codes


def encode(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, codes of the vectors that aren't null."""
    held = vectors.sparkSession.sparkContext.broadcast((books, pair_terms(books)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                codes = choose(_matrix(part.column(1)), *held.value)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(codes.tolist(), pa.list_(pa.int32()))], [ID, "codes"])

    slim = vectors.select(F.col(ID).cast("long").alias(ID), as_double(F.col(VECTOR)).alias(VECTOR)).where(F.col(VECTOR).isNotNull())
    return slim.mapInArrow(run, f"{ID} long, codes array<int>")


def book_table(spark, books: np.ndarray) -> DataFrame:
    """book, code, word."""
    return spark.createDataFrame([(b, c, w.tolist()) for b, own in enumerate(books) for c, w in enumerate(own)], "book int, code int, word array<double>")


def left_over(vectors: DataFrame, coded: DataFrame, table: DataFrame) -> DataFrame:
    """vec_id, codes, rest: vectors less the words of their codes. table: book_table, of bounded size."""
    words = coded.select(ID, F.posexplode("codes").alias("book", "code")).join(F.broadcast(table), ["book", "code"])
    each = words.select(ID, F.posexplode("word").alias("d", "w")).groupBy(ID, "d").agg(F.sum("w").alias("w"))
    sums = each.groupBy(ID).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "w"))), lambda x: x["w"]).alias("sum"))
    rows = vectors.select(F.col(ID).cast("long").alias(ID), as_double(F.col(VECTOR)).alias("v")).join(sums, ID).join(coded, ID)
    return rows.select(ID, "codes", F.zip_with("v", "sum", lambda a, b: a - b).alias("rest"))
