"""Single-file reads and writes inside tasks, on any filesystem pyarrow knows."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from functools import cache
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs

_PIECE = 4 << 20


@cache
def _open_root(root: str) -> tuple[fs.FileSystem, str]:
    """Filesystem and base path of a qualified root such as ``file:/data`` or ``s3a://bucket/x``."""
    scheme = urlsplit(root).scheme
    if scheme in ("", "file"):
        return fs.LocalFileSystem(), "/" + root.removeprefix("file:").lstrip("/")
    # Hadoop's connector name and pyarrow's differ for this store.
    return fs.FileSystem.from_uri("s3" + root[3:] if scheme == "s3a" else root)


def can_open(root: str) -> bool:
    """Whether this Python knows the filesystem of a root."""
    try:
        _open_root(root)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError, ImportError):
        return False
    return True


def read_bytes(root: str, rel: str) -> bytes:
    store, base = _open_root(root)
    with store.open_input_stream(f"{base}/{rel}", compression=None) as stream:
        return stream.read()


def read_into(root: str, rel: str, buffer: bytearray) -> tuple[bytearray, memoryview]:
    """A file's bytes in ``buffer``, or in a new one if it is too small, and a view of them.

    A task that reads many files into few buffers is spared fresh memory for each.
    """
    store, base = _open_root(root)
    with store.open_input_file(f"{base}/{rel}") as source:
        size, at = source.size(), 0
        if len(buffer) < size:
            buffer = bytearray(size + size // 4)
        view = memoryview(buffer)[:size]
        while at < size:
            got = source.readinto(view[at:])
            if not got:
                raise OSError(f"{rel} ended after {at} of {size} bytes")
            at += got
        return buffer, view


def length(root: str, rel: str) -> int | None:
    store, base = _open_root(root)
    info = store.get_file_info(f"{base}/{rel}")
    return info.size if info.type == fs.FileType.File else None


def entries(root: str, folder: str) -> Iterator[tuple[str, int | None]]:
    """What a folder below a root holds itself: names with their lengths, null for folders.

    A local folder is read entry by entry, another store's in the pages its client asks for. Hidden
    names (``_x``, ``.x``), such as files that are still being written, are left out, as Spark's file
    sources do.
    """
    store, base = _open_root(root)
    path = f"{base}/{folder}" if folder else base
    if isinstance(store, fs.LocalFileSystem):
        with os.scandir(path) as found:
            for entry in found:
                if entry.name.startswith(("_", ".")):
                    continue
                if entry.is_dir():
                    yield entry.name, None
                elif entry.is_file():
                    yield entry.name, entry.stat().st_size
        return
    for info in store.get_file_info(fs.FileSelector(path)):
        if not info.base_name.startswith(("_", ".")):
            yield info.base_name, info.size if info.type == fs.FileType.File else None


def _write_pieces(root: str, rel: str, pieces) -> int:
    """Write a file whole: under another name first, then moved, so a lost task leaves no half file."""
    store, base = _open_root(root)
    target = f"{base}/{rel}"
    folder, name = os.path.split(target)
    store.create_dir(folder, recursive=True)
    partial, size = f"{folder}/_{name}.{uuid.uuid4().hex}.part", 0
    with store.open_output_stream(partial, compression=None) as stream:
        for piece in pieces:
            stream.write(piece)
            size += len(piece)
    try:
        store.move(partial, target)
    except OSError:
        # Some filesystems do not move onto a file, such as one a repeated task left.
        store.delete_file(target)
        store.move(partial, target)
    return size


def write_bytes(root: str, rel: str, data) -> int:
    return _write_pieces(root, rel, [data])


def copy(source_root: str, target_root: str, rel: str) -> int:
    """Copy one file under the same relative name, in pieces; returns its size."""
    source, base = _open_root(source_root)
    with source.open_input_stream(f"{base}/{rel}", compression=None) as stream:
        return _write_pieces(target_root, rel, iter(lambda: stream.read(_PIECE), b""))
