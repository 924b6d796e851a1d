"""Metadata of vectors: any bytes a vector, found by their offsets.

A store is a folder of shards, each with a run of ascending ids: ``meta-X.bin``
holds the bytes one behind the other, ``metaindex-X.bin`` an int32 number of
vectors and, as uint64, the number plus one positions between them, ``ids-X.bin``
the ids as int64. ``shards.json`` names the shards that count, so what a lost
task left behind is in no one's way. A folder with one ``meta.bin`` and one
``metaindex.bin`` is a store whose ids are row numbers.

Tasks write and read shards by themselves; a row a shard is all that reaches the
driver. Null metadata is stored as no bytes.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..errors import MeridianError
from . import files

#: Rows of a shard, and bytes that are read at a time.
SHARD_ROWS, PIECE = 1 << 20, 16 << 20


@dataclass
class Shard:
    """Where a shard is; dense: its ids have no gaps, so that a row is found without the file of ids."""

    name: str
    first: int
    last: int
    rows: int
    size: int

    @property
    def dense(self) -> bool:
        return self.last - self.first + 1 == self.rows


def write_metadata(rows: DataFrame, path: str, column: str = "meta", id_column: str = "vec_id", shard_rows: int = SHARD_ROWS) -> None:
    """A store of column (text or bytes) by id. Ids must be there, each once; other columns are left out."""
    data = rows.select(F.col(id_column).cast("long").alias("vec_id"), F.coalesce(F.col(column).cast("binary"), F.lit("").cast("binary")).alias("meta"))
    total, known = data.agg(F.count("*"), F.count("vec_id")).first()
    if total != known:
        raise MeridianError("metadata without an id")
    store, inner = files.resolve(path)
    store.create_dir(inner, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, inner = files.resolve(path)
        name, ids, lengths = uuid.uuid4().hex, [], []
        with store.open_output_stream(f"{inner}/meta-{name}.bin") as out:
            for batch in batches:
                ids.append(batch.column(0).to_numpy())
                lengths.append(pc.binary_length(batch.column(1)).to_numpy().astype(np.int64))
                out.write(b"".join(batch.column(1).to_pylist()))
        own = np.concatenate(ids) if ids else np.empty(0, np.int64)
        if not len(own):
            store.delete_file(f"{inner}/meta-{name}.bin")
            return
        if (np.diff(own) == 0).any():
            raise MeridianError(f"metadata of vector {own[:-1][np.diff(own) == 0][0]} twice")
        positions = np.concatenate(([0], np.cumsum(np.concatenate(lengths))))
        files.write(f"{path}/metaindex-{name}.bin", [struct.pack("<i", len(own)), positions.astype("<u8").tobytes()])
        files.write(f"{path}/ids-{name}.bin", [own.astype("<i8").tobytes()])
        yield pa.RecordBatch.from_pydict({"name": [name], "first": [int(own[0])], "last": [int(own[-1])], "rows": [len(own)], "size": [int(positions[-1])]})

    dealt = data.repartitionByRange(max(1, -(-total // shard_rows)), "vec_id").sortWithinPartitions("vec_id")
    shards = dealt.mapInArrow(write, "name string, first long, last long, rows long, size long").collect()  # a row a shard
    files.write(f"{path}/shards.json", [json.dumps([r.asDict() for r in sorted(shards, key=lambda r: r["first"])]).encode()])


def shards(path: str) -> list[Shard]:
    """The shards of a store in the order of their ids."""
    try:
        here = files.listing(path)
    except OSError as e:
        raise MeridianError(f"no metadata at {path}: {e}") from e
    if "shards.json" in here:
        return [Shard(**s) for s in json.loads(files.read_range(f"{path}/shards.json", 0))]
    if "meta.bin" not in here or "metaindex.bin" not in here:
        raise MeridianError(f"no metadata at {path}")
    head = files.read_range(f"{path}/metaindex.bin", 0, 4)
    n = struct.unpack("<i", head)[0] if len(head) == 4 else -1
    if n < 0 or files.size(f"{path}/metaindex.bin") != 4 + 8 * (n + 1):
        raise MeridianError(f"the index of {path} doesn't have the size that its number of vectors asks for")
    return [Shard("", 0, n - 1, n, files.size(f"{path}/meta.bin"))] if n else []


def _file(path: str, kind: str, shard: Shard) -> str:
    return f"{path}/{kind}-{shard.name}.bin" if shard.name else f"{path}/{kind}.bin"


def _positions(path: str, shard: Shard, first: int, rows: int) -> np.ndarray:
    """The rows + 1 positions from row first of a shard on."""
    found = np.frombuffer(files.read_range(_file(path, "metaindex", shard), 4 + 8 * first, 8 * (rows + 1)), "<u8").astype(np.int64)
    if len(found) != rows + 1 or (np.diff(found) < 0).any() or found[-1] > shard.size:
        raise MeridianError(f"the index of {_file(path, 'meta', shard)} has positions out of order or beyond its end")
    return found


@dataclass
class Span(InputPartition):
    path: str
    shard: Shard
    first: int
    rows: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.step = int(options.get("rowspertask", options.get("rowsPerTask", 1 << 18)))

    def partitions(self) -> list[Span]:
        return [Span(self.path, s, a, min(self.step, s.rows - a)) for s in shards(self.path) for a in range(0, s.rows, self.step)] or [Span(self.path, Shard("", 0, -1, 0, 0), 0, 0)]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        p, s = partition, partition.shard
        if not p.rows:
            return
        at = _positions(p.path, s, p.first, p.rows)
        ids = np.arange(p.first, p.first + p.rows) + s.first if s.dense else np.frombuffer(files.read_range(_file(p.path, "ids", s), 8 * p.first, 8 * p.rows), "<i8")
        row = 0
        while row < p.rows:
            end = max(row + 1, min(int(np.searchsorted(at, at[row] + PIECE, "right")) - 1, p.rows, row + 65_536))
            data = files.read_range(_file(p.path, "meta", s), int(at[row]), int(at[end] - at[row]))
            cut = (at[row : end + 1] - at[row]).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(ids[row:end]), pa.array([data[a:b] for a, b in zip(cut, cut[1:], strict=False)], pa.binary())], ["vec_id", "meta"])
            row = end


class VectorMetadata(DataSource):
    """``spark.read.format("vecmeta").load(folder)``: vec_id, meta of every row of a store."""

    @classmethod
    def name(cls) -> str:
        return "vecmeta"

    def schema(self) -> str:
        return "vec_id long, meta binary"

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options)


def read_metadata(spark: SparkSession, path: str, rows_per_task: int = 1 << 18) -> DataFrame:
    spark.dataSource.register(VectorMetadata)
    return spark.read.format("vecmeta").option("rowsPerTask", rows_per_task).load(path)


def attach(rows: DataFrame, path: str, id_column: str = "vec_id", name: str = "meta") -> DataFrame:
    """rows and the metadata of their ids, null where the store has none: tasks read the bytes of their own ids alone, nothing is joined or shuffled."""
    if name in rows.columns:
        raise MeridianError(f"there is a column {name} already")
    path, place = path.rstrip("/"), rows.columns.index(id_column)
    known = shards(path)
    firsts = np.array([s.first for s in known], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(place)
            found: dict[int, bytes] = {}
            wanted = np.unique(column.drop_null().to_numpy().astype(np.int64))
            home = np.searchsorted(firsts, wanted, "right") - 1
            for h in np.unique(home[home >= 0]):
                found |= _bytes_of(path, known[h], wanted[home == h])
            values = pa.array([found.get(i) for i in column.to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, values], [*batch.schema.names, name])

    return rows.mapInArrow(run, StructType([*rows.schema.fields]).add(name, "binary"))


def _bytes_of(path: str, shard: Shard, ids: np.ndarray) -> dict[int, bytes]:
    """The metadata of those ids that a shard has, by range reads."""
    ids = ids[ids <= shard.last]
    if not shard.dense:
        own = np.frombuffer(files.read_range(_file(path, "ids", shard), 0), "<i8")
        at = np.searchsorted(own, ids)
        ids, at = ids[own[at] == ids], at[own[at] == ids]
    else:
        at = ids - shard.first
    out = {}
    for i, row in zip(ids.tolist(), at.tolist(), strict=True):
        a, b = _positions(path, shard, row, 1).tolist()
        out[i] = files.read_range(_file(path, "meta", shard), a, b - a)
    return out
