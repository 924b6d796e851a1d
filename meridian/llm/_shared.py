"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words everywhere in this subpackage: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where a local session names none."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        shared = f"file://{tempfile.gettempdir()}/meridian-scratch"
        spark.sparkContext.setCheckpointDir(shared)
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared.rstrip("/")


def scratch_path(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder; what is written there goes when the driver ends."""
    path = f"{scratch_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def cut(df: DataFrame, kind: str = "cut") -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there and lost executors don't matter."""
    path = scratch_path(df.sparkSession, kind)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def drop_cut(df: DataFrame) -> None:
    """Delete a table of cut() that nothing reads any more."""
    path = getattr(df, "_scratch", None)
    if path:
        context = df.sparkSession.sparkContext
        hadoop = context._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(context._jsc.hadoopConfiguration()).delete(hadoop, True)


def release(spark: SparkSession, *tables: DataFrame | None) -> None:
    """Delete tables of cut() that nothing reads any more, and let shuffles and broadcasts of finished jobs go.

    Spark deletes those when the driver's garbage is collected, which may be
    long after; many small jobs would keep all their files until then.
    """
    for one in tables:
        if one is not None:
            drop_cut(one)
    gc.collect()
    spark.sparkContext._jvm.java.lang.System.gc()


def fold(column: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus; a null id counts as empty text."""
    column = F.col(column) if isinstance(column, str) else column
    return (F.crc32(F.coalesce(column.cast("string"), F.lit(""))) % modulus).cast("int")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def most_frequent(df: DataFrame, count: str, limit: int) -> DataFrame:
    """The rows of df with the largest counts, at most limit of them; rows of nearly the same count stay or go together,
    unless those of the largest alone are too many: of them a part by a hash stays.

    A histogram over logarithmic steps of the count gives the threshold: a few
    thousand rows reach the driver, whatever the size of df, and nothing is sorted.
    """
    step = F.floor(F.log2(F.col(count)) * 64).cast("int")
    total, least = 0, None
    for value, rows in sorted(df.groupBy(step.alias("step")).agg(F.count("*").alias("rows")).collect(), reverse=True):
        if total + rows > limit:
            if least is None:
                part = F.pmod(F.xxhash64(*df.columns), F.lit(1 << 30)) < int((1 << 30) * 0.9 * limit / rows)
                return df.where((step == value) & part).limit(limit)
            break
        total, least = total + rows, value
    return df.where(step >= least) if least is not None else df.limit(0)


# ---------------------------------------------------------------------------
# Words of whole Arrow batches as 64-bit hashes, without a Python object a word

_MULTIPLIER = 0x9E3779B97F4A7C15
_PIECE = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: ASCII white space and punctuation, for operators that look at words without it.
PUNCTUATED = np.zeros(256, bool)
PUNCTUATED[[b for b in range(128) if not chr(b).isalnum()]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        n = max(n, _PIECE + 1)
        inverse = pow(_MULTIPLIER, -1, 1 << 64)
        _powers[:] = [np.concatenate(([np.uint64(1)], np.cumprod(np.full(n - 1, m, np.uint64), dtype=np.uint64))) for m in (_MULTIPLIER, inverse)]
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (murmur's)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    content = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return content[bounds[0] : bounds[-1]], bounds - bounds[0]


def pieces(content: np.ndarray, bounds: np.ndarray, limit: int = _PIECE):
    """Cut bytes into runs of about limit bytes, between rows or else between words: (start, end)."""
    at, end = 0, int(bounds[-1])
    while at < end:
        to = min(end, at + limit)
        if to < end:
            row = int(bounds[np.searchsorted(bounds, to, "right") - 1])
            if row > at:
                to = row
            else:  # inside one long row: on to its next white space
                while to < end:
                    gap = np.flatnonzero(_SPACE[content[to : to + 4096]])
                    if len(gap):
                        to += int(gap[0])
                        break
                    to = min(end, to + 4096)
                to = min(to, int(bounds[np.searchsorted(bounds, at, "right")]))
        yield at, to
        at = to


def word_spans(content: np.ndarray, bounds: np.ndarray, gap: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a piece; rows end words."""
    inside = ~gap[content]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    cuts = bounds[(bounds > 0) & (bounds < len(content))]
    starts[cuts] = inside[cuts]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    ends[cuts - 1] = inside[cuts - 1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def hash_words(content: np.ndarray, bounds: np.ndarray, lower: bool = True, gap: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each row and the end). A-Z count as a-z if lower; bytes of gap end words."""
    hashes, starts_at = [], []
    for a, b in pieces(content, bounds):
        part = content[a:b]
        starts, ends = word_spans(part, bounds - a, gap)
        power, inverse = _power_tables(len(part) + 1)
        value = (_LOWER[part] if lower else part).astype(np.uint64) + np.uint64(1)
        total = np.concatenate(([np.uint64(0)], np.cumsum(value * power[: len(part)], dtype=np.uint64)))
        h = (total[ends] - total[starts]) * inverse[starts]
        hashes.append(mix(h ^ (ends - starts).astype(np.uint64)))
        starts_at.append(starts + a)
    if not hashes:
        return np.empty(0, np.uint64), np.zeros(len(bounds), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts_at), bounds)


class HashIndex:
    """Places of 64-bit hashes in a sorted table, looked up an array at a time."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.shift = np.uint64(64 - max(1, int(len(keys)).bit_length()))
        self.first = np.searchsorted(keys >> self.shift, np.arange((1 << (64 - int(self.shift))) + 1, dtype=np.uint64)).astype(np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash, or -1."""
        bucket = (hashes >> self.shift).astype(np.int64)
        at, end = self.first[bucket], self.first[bucket + 1]
        out = np.full(len(hashes), -1, np.int32)
        left = np.flatnonzero(at < end)
        at, end, wanted = at[left], end[left], hashes[left]
        while len(left):
            hit = self.keys[at] == wanted
            out[left[hit]] = at[hit]
            go = ~hit & (at + 1 < end)
            left, at, end, wanted = left[go], at[go] + 1, end[go], wanted[go]
        return out


def slices(batch: pa.RecordBatch, most_bytes: int = 4 << 20, *columns: int, most_rows: int = 1 << 16):
    """Parts of a batch whose text columns (the first, if none is named) are about most_bytes, of most_rows at most; a longer text is a part of its own."""
    lengths = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns or (0,))
    sizes = np.concatenate(([0], np.cumsum(lengths)))
    at = 0
    while at < batch.num_rows:
        to = min(at + most_rows, max(at + 1, int(np.searchsorted(sizes, sizes[at] + most_bytes, "right")) - 1))
        yield batch.slice(at, to - at)
        at = to
