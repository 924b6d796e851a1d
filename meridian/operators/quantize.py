"""Product and scalar quantisation: training, encoding, decoding and distances of codes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import as_double, squared_norm, total
from .knn import ID, QUERY, QUERY_VECTOR, VECTOR, _matrix
from .kmeans import lloyd, sample_rows


# -- product quantisation ----------------------------------------------------


def chunks_of(vectors: DataFrame, chunks: int, dims: int, vector: str = VECTOR) -> DataFrame:
    """A row a vector and chunk: chunk, sub. dims is a multiple of chunks."""
    size = dims // chunks
    subs = F.array(*(F.struct(F.lit(c).alias("chunk"), F.slice(as_double(F.col(vector)), c * size + 1, size).alias("sub")) for c in range(chunks)))
    return vectors.withColumn("part", F.explode(subs)).select(*[c for c in vectors.columns if c != vector], "part.chunk", "part.sub")


def codebook_from_vectors(vectors: DataFrame, ids: int, chunks: int, dims: int) -> DataFrame:
    """chunk, code, sub: code word j of a chunk is that part of the vector with id j."""
    picked = vectors.where((F.col(ID) >= 0) & (F.col(ID) < ids)).select(F.col(ID).cast("int").alias("code"), VECTOR)
    return chunks_of(picked, chunks, dims).select("chunk", "code", "sub")


def encode(vectors: DataFrame, codebook: DataFrame, chunks: int, dims: int) -> DataFrame:
    """vec_id, codes: the nearest code word of each chunk, the smaller code among equals.

    A codebook has at most 256 rows a chunk; it is broadcast as one row a chunk.
    """
    words = codebook.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("code", "sub"))).alias("words"))
    parts = chunks_of(vectors.select(ID, VECTOR), chunks, dims).join(F.broadcast(words), "chunk")
    apart = lambda w: total(F.zip_with("sub", w["sub"], lambda x, y: (x - y) * (x - y)))
    best = F.array_min(F.transform("words", lambda w: F.struct(apart(w).alias("d"), w["code"].alias("code"))))["code"]
    coded = parts.select(ID, "chunk", best.alias("code"))
    return coded.groupBy(ID).agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "code"))), lambda x: x["code"]).alias("codes"))


def lookup_tables(queries: DataFrame, codebook: DataFrame, chunks: int, dims: int, centroid: Column | None = None) -> DataFrame:
    """query_id, lut: lut[chunk][code] is the squared distance of a query's part, less the global centroid if given, to each code word."""
    q = as_double(F.col(QUERY_VECTOR)) if centroid is None else F.zip_with(as_double(F.col(QUERY_VECTOR)), centroid, lambda a, b: a - b)
    words = codebook.groupBy("chunk").agg(F.transform(F.sort_array(F.collect_list(F.struct("code", "sub"))), lambda w: w["sub"]).alias("words"))
    book = words.agg(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "words"))), lambda w: w["words"]).alias("book"))
    size = dims // chunks

    def row(words: Column, c: Column) -> Column:
        sub = F.slice(F.col("v"), c * size + 1, F.lit(size))
        return F.transform(words, lambda w: total(F.zip_with(sub, w, lambda x, y: (x - y) * (x - y))))

    joined = queries.select(QUERY, q.alias("v")).join(F.broadcast(book))  # one row: the codebook
    return joined.select(QUERY, F.transform("book", row).alias("lut"))


def adc(lut: Column, codes: Column) -> Column:
    """Asymmetric distance: the sum of lut[chunk][code]."""
    return total(F.zip_with(lut, codes, lambda row, c: F.element_at(row, c.cast("int") + 1)))


def decode(coded: DataFrame, codebook: DataFrame) -> DataFrame:
    """vec_id, embedding from codes."""
    parts = coded.select(ID, F.posexplode("codes").alias("chunk", "code")).join(F.broadcast(codebook), ["chunk", "code"])
    return parts.groupBy(ID).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "sub"))), lambda x: x["sub"])).alias(VECTOR))


def pair_table(codebook: DataFrame) -> DataFrame:
    """chunk, a, b, d: squared distances between the code words of a chunk."""
    left = codebook.select("chunk", F.col("code").alias("a"), F.col("sub").alias("x"))
    right = codebook.select("chunk", F.col("code").alias("b"), F.col("sub").alias("y"))
    return left.join(right, "chunk").select("chunk", "a", "b", total(F.zip_with("x", "y", lambda x, y: (x - y) * (x - y))).alias("d"))


def train_codebook(vectors: DataFrame, chunks: int, dims: int, codes: int = 256, sample: int = 65_536, iterations: int = 10, seed: int = 0) -> DataFrame:
    """chunk, code, sub by k-means of each part over a bounded sample, a chunk a task."""
    parts = chunks_of(sample_rows(vectors.select(ID, VECTOR), sample), chunks, dims)

    def fit(key, group):
        table = group.sort_by(ID)
        x = _matrix(table["sub"].combine_chunks())
        centres = lloyd(x, min(codes, len(x)), iterations, seed)[0]
        chunk = key[0].as_py()
        return pa.table({"chunk": pa.array([chunk] * len(centres), pa.int32()), "code": pa.array(range(len(centres)), pa.int32()), "sub": pa.array(centres.tolist(), pa.list_(pa.float64()))})

    return parts.groupBy("chunk").applyInArrow(fit, "chunk int, code int, sub array<double>")


def rotate(vectors: DataFrame, matrix: np.ndarray) -> DataFrame:
    """Vectors times an orthogonal matrix."""
    held = vectors.sparkSession.sparkContext.broadcast(np.asarray(matrix, float))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = _matrix(batch.column(1)) @ held.value if batch.num_rows else np.empty((0, 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(out), pa.list_(pa.float64()))], [ID, VECTOR])

    return vectors.select(ID, as_double(F.col(VECTOR)).alias(VECTOR)).mapInArrow(run, f"{ID} long, {VECTOR} array<double>")


# -- scalar quantisation -----------------------------------------------------


def ranges(vectors: DataFrame, uniform: bool = False) -> DataFrame:
    """dim, low, high; of all dimensions together if uniform."""
    each = vectors.select(F.posexplode(as_double(F.col(VECTOR))).alias("dim", "x"))
    by = each.groupBy("dim").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    if not uniform:
        return by
    whole = by.agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return by.select("dim").join(F.broadcast(whole))  # one row


def range_arrays(ranges_: DataFrame) -> DataFrame:
    """One row: low and high as arrays."""

    def ordered(name: str) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.struct("dim", name))), lambda x: x[name]).alias(name)

    return ranges_.agg(ordered("low"), ordered("high"))


def scalar_encode(vector: Column, low: Column, high: Column, bits: int) -> Column:
    """Codes 0..2^bits-1 by rounding down into equal steps; a dimension without range gives 0."""
    top = (1 << bits) - 1
    spread = F.arrays_zip(low.alias("l"), high.alias("h"))
    return F.zip_with(as_double(vector), spread, lambda x, r: F.when(r["h"] > r["l"], F.greatest(F.lit(0), F.least(F.lit(top), F.floor((x - r["l"]) / (r["h"] - r["l"]) * top).cast("int")))).otherwise(F.lit(0)))


def scalar_decode(codes: Column, low: Column, high: Column, bits: int) -> Column:
    """The middle of each step."""
    top = (1 << bits) - 1
    spread = F.arrays_zip(low.alias("l"), high.alias("h"))
    return F.zip_with(codes, spread, lambda c, r: r["l"] + (c + F.lit(0.5)) / top * (r["h"] - r["l"]))


def direct_encode(vector: Column) -> Column:
    """Values that already are 0..255."""
    return F.transform(vector, lambda x: F.greatest(F.lit(0), F.least(F.lit(255), x.cast("int"))))


def half_round(x: float) -> float:
    """A number as half precision keeps it."""
    return float(np.float16(x))


def int8_scale(vectors: DataFrame) -> DataFrame:
    """One row: scale, the largest magnitude over 127, 1 if all is zero."""
    biggest = F.max(F.array_max(F.transform(as_double(F.col(VECTOR)), lambda x: F.abs(x))))
    return vectors.agg(F.when(biggest > 0, biggest / 127.0).otherwise(F.lit(1.0)).alias("scale"))


def int8_encode(vector: Column, scale: Column) -> Column:
    """Symmetric codes, rounded half to even and clamped to 127."""
    return F.transform(as_double(vector), lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.rint(x / scale).cast("int"))))


def int8_own_scale(vector: Column) -> Column:
    biggest = F.array_max(F.transform(as_double(vector), lambda x: F.abs(x)))
    return F.when(biggest > 0, biggest / 127.0).otherwise(F.lit(1.0))


def int8_distance(q: Column, q_codes: Column, q_scale: Column, x_norm: Column, x_codes: Column, x_scale: Column) -> Column:
    """Norms of the exact vectors, dot product of the codes; it can be negative."""
    dot = F.aggregate(F.zip_with(q_codes, x_codes, lambda a, b: a * b), F.lit(0), lambda s, v: s + v)
    return squared_norm(q) + x_norm - F.lit(2.0) * dot * (q_scale * x_scale)


def int8_matrix(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """int8_distance of every q with every x: codes, then norm and scale. Products of codes are whole numbers, so their sums are exact."""
    return q[:, -2][:, None] + x[:, -2][None] - 2.0 * (q[:, :-2] @ x[:, :-2].T) * (q[:, -1][:, None] * x[:, -1][None])


def score_clusters(queries: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, dist: a matrix product for the queries and members of each cluster.

    queries: centroid_id, query_id, q; members: centroid_id, vec_id, embedding.
    Queries are a stated set, sent in blocks; members come in Arrow batches, so
    a large cluster is never held whole. Results are cut to k a query.
    """
    from .ivf import scan_blocked

    return scan_blocked(queries.select(QUERY, "centroid_id"), queries.select(QUERY, QUERY_VECTOR).dropDuplicates([QUERY]), members, k).select(QUERY, ID, "dist")
