"""Bytes of files in any store: local paths, or what a URI names."""

from __future__ import annotations

from pyarrow import fs

from ..errors import MeridianError


def resolve(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    return fs.LocalFileSystem(), path


def read_range(path: str, start: int, length: int | None = None) -> bytes:
    store, inner = resolve(path)
    with store.open_input_file(inner) as f:
        f.seek(start)
        return f.read() if length is None else f.read(length)


def size(path: str) -> int:
    store, inner = resolve(path)
    info = store.get_file_info(inner)
    if info.type != fs.FileType.File:
        raise MeridianError(f"no such file: {path}")
    return info.size


def exists(path: str) -> bool:
    store, inner = resolve(path)
    return store.get_file_info(inner).type != fs.FileType.NotFound


def listing(folder: str) -> list[str]:
    """Names in a folder."""
    store, inner = resolve(folder)
    return sorted(i.base_name for i in store.get_file_info(fs.FileSelector(inner)))


def write(path: str, parts) -> None:
    store, inner = resolve(path)
    with store.open_output_stream(inner) as f:
        for part in parts:
            f.write(part)
