"""Tables of results after an interrupted point of a sweep.

Before a point the lengths of all files are kept; a point that didn't end leaves
rows behind. Where a table names the point's setting in a column, rows of points
that were completed stay, whatever the files' lengths. A table without that
column can't say whose its rows are: it goes back to its files' lengths from
before the point, and what was written since is kept aside, unless every point
was completed.

A table is a folder of CSV parts with headers. Files are read, written, shortened
and copied by tasks; names and lengths alone reach the driver.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..errors import MeridianError
from ..shipping import ship
from . import files

COPIED = 1 << 20


def _tables(folder: str) -> list[str]:
    store, inner = files.resolve(folder)
    return sorted(i.base_name for i in store.get_file_info(fs.FileSelector(inner)) if i.type == fs.FileType.Directory and i.base_name[0] not in "._")


def _lengths(folder: str) -> dict[str, int]:
    store, inner = files.resolve(folder)
    return {i.base_name: i.size for i in store.get_file_info(fs.FileSelector(inner)) if i.type == fs.FileType.File and i.base_name[0] not in "._"}


def snapshot(folder: str, state: str) -> None:
    """Keep the lengths of all files of all tables of folder in the file state; call it before a point."""
    files.write(state, [json.dumps({t: _lengths(f"{folder}/{t}") for t in _tables(folder)}).encode()])


def recover(spark: SparkSession, folder: str, state: str, stem: str, axis: str, completed: Iterable, all_done: bool = False) -> dict[str, str]:
    """What was done with each table of folder: kept, filtered or shortened.

    Rows of other stems stay, and those of stem whose axis is in completed; a
    null or missing axis isn't completed. Done again, it changes nothing more,
    and one that was broken off can be done again.
    """
    ship(spark)
    folder = folder.rstrip("/")
    before = json.loads(files.read_range(state, 0))
    store, inner = files.resolve(folder)
    for name in files.listing(folder):
        if name.startswith(".old-"):
            table = name[len(".old-") :]
            if files.exists(f"{folder}/{table}"):
                store.delete_dir(f"{inner}/{name}")
            else:
                store.move(f"{inner}/{name}", f"{inner}/{table}")
    return {t: _recover_table(spark, folder, t, before.get(t, {}), stem, axis, {str(c) for c in completed}, all_done) for t in _tables(folder)}


def _recover_table(spark: SparkSession, folder: str, table: str, before: dict[str, int], stem: str, axis: str, completed: set[str], all_done: bool) -> str:
    path = f"{folder}/{table}"
    lengths = _lengths(path)
    if not any(lengths.values()):
        return "kept"
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if axis not in rows.columns:
        longer = {n: size for n, size in lengths.items() if size > before.get(n, 0)}
        if all_done or not longer:
            return "kept"
        _shorten(spark, folder, table, {n: before.get(n, 0) for n in longer})
        return "shortened"
    if "stem" not in rows.columns:
        raise MeridianError(f"{table} has {axis} but no stem")
    own = F.coalesce(F.col("stem") == stem, F.lit(False))
    lost = own & ~F.coalesce(F.col(axis).isin(*completed) if completed else F.lit(False), F.lit(False))
    if rows.where(lost).isEmpty():
        return "kept"
    fresh = f".recovery-{uuid.uuid4().hex}"
    rows.where(~lost).write.option("header", True).option("escape", '"').csv(f"{folder}/{fresh}")
    store, inner = files.resolve(folder)
    store.move(f"{inner}/{table}", f"{inner}/.old-{table}")
    store.move(f"{inner}/{fresh}", f"{inner}/{table}")
    store.delete_dir(f"{inner}/.old-{table}")
    return "filtered"


def _shorten(spark: SparkSession, folder: str, table: str, keep: dict[str, int]) -> None:
    """Cut files to their lengths; what they were is copied to a folder .unassigned-X/table before, by a task a file."""
    aside = f".unassigned-{uuid.uuid4().hex}/{table}"
    store, inner = files.resolve(folder)
    store.create_dir(f"{inner}/{aside}", recursive=True)

    def copy(source: str, target: str, most: int | None) -> None:
        with store_of(source)[0].open_input_stream(store_of(source)[1]) as read, store_of(target)[0].open_output_stream(store_of(target)[1]) as out:
            left = most
            while left is None or left:
                piece = read.read(COPIED if left is None else min(COPIED, left))
                if not piece:
                    return
                out.write(piece)
                left = None if left is None else left - len(piece)

    store_of = files.resolve

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, most in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                whole = f"{folder}/{aside}/{name}.raw"
                # a task that is done again finds the whole file aside, and the file itself shortened or gone
                if not files.exists(whole):
                    part = f"{whole}.{uuid.uuid4().hex}"
                    copy(f"{folder}/{table}/{name}", part, None)
                    store_of(part)[0].move(store_of(part)[1], store_of(whole)[1])
                if most:
                    part = f"{folder}/{table}/.{uuid.uuid4().hex}"
                    copy(whole, part, most)
                    store_of(part)[0].move(store_of(part)[1], store_of(f"{folder}/{table}/{name}")[1])
                elif files.exists(f"{folder}/{table}/{name}"):
                    there, path = store_of(f"{folder}/{table}/{name}")
                    there.delete_file(path)
                checksum = f"{folder}/{table}/.{name}.crc"
                if files.exists(checksum):  # of the file as it was
                    store_of(checksum)[0].delete_file(store_of(checksum)[1])
            yield batch

    # a row a file that has grown
    spark.createDataFrame(list(keep.items()), "name string, keep long").repartition("name").mapInArrow(run, "name string, keep long").count()
