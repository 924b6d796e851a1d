"""Binary vector files as Spark data sources.

``vecbin``: a header of two int32, number and dimensions, then rows; the element
type is told by the suffix (.fbin float32, .u8bin uint8, .i8bin int8, .ibin
int32, else the option ``dtype``). ``xvecs``: every row has its own int32
dimensions (.fvecs, .ivecs, .bvecs). Rows have a fixed length, so a file is read
by as many tasks as ``rowsPerTask`` gives, each seeking to its own rows. Columns:
vec_id (row number), embedding.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..errors import MeridianError
from . import files

#: Fixed values of the formats.
SUFFIXES = {".fbin": "float32", ".u8bin": "uint8", ".i8bin": "int8", ".ibin": "int32", ".bin": "int32", ".fvecs": "float32", ".ivecs": "int32", ".bvecs": "uint8"}
MAX_INT32 = (1 << 31) - 1


def dtype_of(path: str, stated: str | None = None) -> np.dtype:
    if stated:
        return np.dtype(stated).newbyteorder("<")
    for suffix, name in SUFFIXES.items():
        if path.endswith(suffix):
            return np.dtype(name).newbyteorder("<")
    raise MeridianError(f"element type of {path} is unknown; state dtype")


@dataclass
class Rows(InputPartition):
    path: str
    offset: int
    first: int
    rows: int
    dims: int
    head: int
    dtype: str


def _schema(dtype: np.dtype) -> str:
    return "vec_id long, embedding array<%s>" % {"f": "float", "i": "int", "u": "int"}[dtype.kind]


def _read(p: Rows) -> Iterator[pa.RecordBatch]:
    dtype = np.dtype(p.dtype)
    record = p.head + p.dims * dtype.itemsize
    kind = pa.float32() if dtype.kind == "f" else pa.int32()
    for at in range(0, p.rows, 65_536):
        n = min(65_536, p.rows - at)
        data = files.read_range(p.path, p.offset + (p.first + at) * record, n * record)
        if len(data) != n * record:
            raise MeridianError(f"{p.path} is truncated")
        raw = np.frombuffer(data, np.uint8).reshape(n, record)
        if p.head and (raw[:, :4].copy().view("<i4") != p.dims).any():
            raise MeridianError(f"{p.path} has rows of different dimensions")
        values = raw[:, p.head :].copy().view(dtype).astype(np.float32 if dtype.kind == "f" else np.int32)
        flat = pa.array(values.reshape(-1), kind)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * p.dims), flat)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(p.first + at, p.first + at + n)), lists], ["vec_id", "embedding"])


class _Reader(DataSourceReader):
    def __init__(self, options: dict, xvecs: bool):
        self.path, self.xvecs = options["path"], xvecs
        self.step = int(options.get("rowspertask", options.get("rowsPerTask", 1 << 20)))
        self.dtype = dtype_of(self.path, options.get("dtype"))
        self.base = int(options.get("offset", 0))

    def partitions(self) -> list[Rows]:
        total = files.size(self.path)
        if self.xvecs:
            if not total:
                return [Rows(self.path, 0, 0, 0, 1, 4, self.dtype.str)]
            (dims,) = struct.unpack("<i", files.read_range(self.path, 0, 4))
            record = 4 + dims * self.dtype.itemsize
            if dims <= 0 or total % record:
                raise MeridianError(f"{self.path} isn't made of rows of {dims} dimensions")
            n, head, start = total // record, 4, 0
        else:
            header = files.read_range(self.path, self.base, 8)
            if len(header) < 8:
                raise MeridianError(f"{self.path} has no header")
            n, dims = struct.unpack("<ii", header)
            head, start = 0, self.base + 8
            if n < 0 or dims <= 0 or total < start + n * dims * self.dtype.itemsize:
                raise MeridianError(f"{self.path} is shorter than its header says")
        return [Rows(self.path, start, a, min(self.step, n - a), dims, head, self.dtype.str) for a in range(0, n, self.step)] or [Rows(self.path, start, 0, 0, max(dims, 1), head, self.dtype.str)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        return _read(partition)


@dataclass
class Written(WriterCommitMessage):
    part: str
    rows: int
    dims: int
    first: int


class _Writer(DataSourceWriter):
    """Each task writes its rows beside the target; the driver joins them behind a header, ordered by first id."""

    def __init__(self, options: dict):
        self.path, self.dtype = options["path"], dtype_of(options["path"], options.get("dtype"))

    def write(self, rows: Iterator) -> Written:
        part, n, dims, first = f"{self.path}.{uuid.uuid4().hex}.part", 0, 0, 0

        def encoded() -> Iterator[bytes]:
            nonlocal n, dims, first
            for row in rows:
                values = np.asarray(row["embedding"], self.dtype)
                if n and len(values) != dims:
                    raise MeridianError("vectors of different dimensions")
                if not n:
                    dims, first = len(values), row["vec_id"]
                n += 1
                yield values.tobytes()

        files.write(part, encoded())
        return Written(part, n, dims, first)

    def commit(self, messages: list[Written | None]) -> None:
        parts = sorted((m for m in messages if m and m.rows), key=lambda m: m.first)
        n, dims = sum(m.rows for m in parts), (parts[0].dims if parts else 1)
        if n > MAX_INT32 or any(m.dims != dims for m in parts):
            raise MeridianError("too many vectors, or of different dimensions")

        def content() -> Iterator[bytes]:
            yield struct.pack("<ii", n, dims)
            for m in parts:
                total = files.size(m.part)
                for at in range(0, total, 1 << 24):
                    yield files.read_range(m.part, at, 1 << 24)

        files.write(self.path, content())
        self._drop(messages)

    def abort(self, messages: list[Written | None]) -> None:
        self._drop(messages)

    @staticmethod
    def _drop(messages: list[Written | None]) -> None:
        for m in messages:
            if m:
                store, inner = files.resolve(m.part)
                store.delete_file(inner)


class VecBin(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vecbin"

    def schema(self) -> str:
        return _schema(dtype_of(self.options["path"], self.options.get("dtype")))

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, False)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options)


class XVecs(VecBin):
    @classmethod
    def name(cls) -> str:
        return "xvecs"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, True)


def register(spark: SparkSession) -> None:
    """Make both formats known to spark.read and df.write."""
    spark.dataSource.register(VecBin)
    spark.dataSource.register(XVecs)


def read_vectors(spark: SparkSession, path: str, **options) -> DataFrame:
    register(spark)
    kind = "xvecs" if path.endswith("vecs") else "vecbin"
    return spark.read.format(kind).options(**options).load(path)


def write_vectors(vectors: DataFrame, path: str, tasks: int = 8, **options) -> None:
    """One file in order of vec_id."""
    register(vectors.sparkSession)
    ordered = vectors.select("vec_id", "embedding").repartitionByRange(tasks, "vec_id").sortWithinPartitions("vec_id")
    ordered.write.format("vecbin").options(**options).mode("append").save(path)


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """query_id, rank, vec_id of a ground-truth file."""
    rows = read_vectors(spark, path, dtype="int32")
    return rows.select(F.col("vec_id").alias("query_id"), F.posexplode("embedding").alias("p", "id")).select("query_id", (F.col("p") + 1).alias("rank"), F.col("id").cast("long").alias("vec_id"))


def write_results(results: DataFrame, prefix: str, k: int) -> None:
    """<prefix>_ids.bin and <prefix>_distances.bin; places not filled are -1 and infinite."""
    lists = results.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "dist"))).alias("r"))
    pad = lambda a, x: F.slice(F.concat(a, F.array_repeat(F.lit(x), k)), 1, k)
    ids = lists.select(F.col("query_id").alias("vec_id"), pad(F.transform("r", lambda x: x["vec_id"].cast("int")), -1).alias("embedding"))
    dist = lists.select(F.col("query_id").alias("vec_id"), pad(F.transform("r", lambda x: x["dist"].cast("float")), float("inf")).alias("embedding"))
    write_vectors(ids, f"{prefix}_ids.bin", dtype="int32")
    write_vectors(dist, f"{prefix}_distances.bin", dtype="float32")
