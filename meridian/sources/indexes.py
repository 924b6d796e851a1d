"""Files of on-disk graph indexes: discovery, header, pages, codebooks, codes, navigation graph."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import MeridianError
from . import files

#: Fixed values of the format.
PAGE = 4096


@dataclass
class Header:
    """What the first page of a graph index tells."""

    vectors: int
    dims: int
    medoid: int
    node_bytes: int
    nodes_per_page: int

    def degree(self, element_bytes: int) -> int:
        return (self.node_bytes - self.dims * element_bytes) // 4 - 1

    def page_of(self, node: Column) -> Column:
        """Nodes' page, behind the header page."""
        return F.floor(node / self.nodes_per_page).cast("long") + 1


def read_header(path: str) -> Header:
    page = files.read_range(path, 0, PAGE)
    if len(page) < 8 + 5 * 8:
        raise MeridianError(f"{path} has no header page")
    n, dims, medoid, node_bytes, per_page = struct.unpack_from("<5Q", page, 8)
    if not per_page or node_bytes > PAGE or not dims:
        raise MeridianError(f"{path} has a broken header")
    return Header(n, dims, medoid, node_bytes, per_page)


def write_graph(path: str, ids_vectors_neighbors: list[tuple[np.ndarray, list[int]]], dtype: str, medoid: int, degree: int) -> None:
    """A graph index of nodes in order of id."""
    kind = np.dtype(dtype).newbyteorder("<")
    dims = len(ids_vectors_neighbors[0][0])
    node = dims * kind.itemsize + 4 * (degree + 1)
    per_page = PAGE // node
    if not per_page:
        raise MeridianError("a node doesn't fit in a page")
    head = struct.pack("<II", 9, 1) + struct.pack("<9Q", len(ids_vectors_neighbors), dims, medoid, node, per_page, 0, 0, 0, 0)
    pages = [head.ljust(PAGE, b"\0")]
    for at in range(0, len(ids_vectors_neighbors), per_page):
        body = b""
        for vector, near in ids_vectors_neighbors[at : at + per_page]:
            body += np.asarray(vector, kind).tobytes() + struct.pack("<i", len(near)) + np.asarray(near, "<i4").tobytes().ljust(4 * degree, b"\xff")
        pages.append(body.ljust(PAGE, b"\0"))
    files.write(path, pages)


def read_graph(spark: SparkSession, path: str, dtype: str, pages_per_task: int = 4096) -> DataFrame:
    """vec_id, embedding, neighbors of every node; pages are read by many tasks."""
    head, kind = read_header(path), np.dtype(dtype).newbyteorder("<")
    pages = -(-head.vectors // head.nodes_per_page)
    if files.size(path) < (pages + 1) * PAGE:
        raise MeridianError(f"{path} lacks pages")
    width = head.dims * kind.itemsize

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for start in batch.column(0).to_pylist():
                rows = []
                n = min(pages_per_task, pages - start)
                data = files.read_range(path, (start + 1) * PAGE, n * PAGE)
                for p in range(n):
                    for s in range(head.nodes_per_page):
                        node = (start + p) * head.nodes_per_page + s
                        if node >= head.vectors:
                            break
                        at = p * PAGE + s * head.node_bytes
                        (degree,) = struct.unpack_from("<i", data, at + width)
                        rows.append({"vec_id": node, "embedding": np.frombuffer(data, kind, head.dims, at).astype(float).tolist(), "neighbors": np.frombuffer(data, "<i4", degree, at + width + 4).tolist()})
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float64())), ("neighbors", pa.list_(pa.int64()))]))

    starts = spark.range(0, pages, pages_per_task)
    return starts.repartition(max(1, -(-pages // pages_per_task))).mapInArrow(run, "vec_id long, embedding array<double>, neighbors array<long>")


def stripe(page: Column, devices: int, base: int = 0) -> tuple[Column, Column]:
    """Device and block of a page that is dealt over devices in turn."""
    return (page % devices).alias("device"), (F.lit(base) + F.floor(page / devices)).cast("long").alias("block")


def discover(folder: str) -> dict[str, str | None]:
    """Index, pivots, codes and navigation graph of a folder; an ambiguous or missing index is an error."""
    names = files.listing(folder)

    def one(suffix: str, plain: str, needed: bool) -> str | None:
        hits = [n for n in names if n.endswith("_" + suffix)]
        if len(hits) > 1:
            raise MeridianError(f"several files end in _{suffix}: {hits}")
        if hits:
            return f"{folder}/{hits[0]}"
        if plain in names:
            return f"{folder}/{plain}"
        if needed:
            raise MeridianError(f"{folder} has no {plain}")
        return None

    return {
        "index": one("disk.index", "disk.index", True),
        "pivots": one("pq_pivots.bin", "pq_pivots.bin", False),
        "codes": one("pq_compressed.bin", "pq_compressed.bin", False),
        "nav": f"{folder}/nav" if "nav" in names else None,
    }


def _typed(data: bytes, at: int, kind: str) -> np.ndarray:
    n, d = struct.unpack_from("<ii", data, at)
    return np.frombuffer(data, np.dtype(kind).newbyteorder("<"), n * d, at + 8).reshape(n, d)


def read_pivots(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pivots [256, dims], global centroid [dims], first dimension of each chunk and the end.

    A table of 4 or 5 section offsets comes first; chunk offsets are the last
    section but one there, counted so that a 5-entry table has them one later.
    """
    data = files.read_range(path, 0)
    n, _ = struct.unpack_from("<ii", data, 0)
    if n not in (4, 5):
        raise MeridianError(f"{path} has {n} section offsets")
    at = np.frombuffer(data, "<u8", n, 8).astype(int)
    return _typed(data, at[0], "float32"), _typed(data, at[1], "float32").ravel(), _typed(data, at[2 if n == 4 else 3], "int32").ravel()


def write_pivots(path: str, pivots: np.ndarray, centroid: np.ndarray, chunks: np.ndarray) -> None:
    def section(x: np.ndarray, kind: str) -> bytes:
        x = np.atleast_2d(np.asarray(x)) if np.ndim(x) > 1 else np.asarray(x).reshape(-1, 1)
        return struct.pack("<ii", *x.shape) + x.astype(np.dtype(kind).newbyteorder("<")).tobytes()

    parts = [section(pivots, "float32"), section(centroid, "float32"), section(chunks, "int32")]
    at = np.cumsum([PAGE, *(len(p) for p in parts)])
    head = (struct.pack("<ii", 4, 1) + at.astype("<u8").tobytes()).ljust(PAGE, b"\0")
    files.write(path, [head, *parts])


def read_nav(folder: str, dtype: str) -> tuple[np.ndarray, list[int], list[list[int]], int]:
    """Vectors, base ids, neighbours and start of a navigation graph."""
    vectors = _typed(files.read_range(f"{folder}/nav_index.data", 0), 0, dtype)
    base = [int(x) for x in files.read_range(f"{folder}/map.txt", 0).split()]
    data = np.frombuffer(files.read_range(f"{folder}/nav_index", 0), "<i4")
    start, at, near = int(data[5]), 6, []
    for _ in range(len(vectors)):
        n = int(data[at])
        near.append(data[at + 1 : at + 1 + n].tolist())
        at += 1 + n
    if len(base) != len(vectors):
        raise MeridianError(f"{folder}: {len(vectors)} vectors, {len(base)} ids")
    return vectors, base, near, start
