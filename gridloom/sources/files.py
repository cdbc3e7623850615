"""Single files, opened where the work is: by executors, on any file system that Arrow reaches."""

from __future__ import annotations

import re
import uuid

import pyarrow.fs as pafs


def locate(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and inner path. Plain paths, and ``file:`` with any number of slashes, are local or mounted."""
    local = re.match(r"file:/*(/.*)", path)
    if local or "://" not in path:
        return pafs.LocalFileSystem(), local.group(1) if local else path
    return pafs.FileSystem.from_uri(path)


def open_file(path: str):
    """A seekable file."""
    system, inner = locate(path)
    return system.open_input_file(inner)


def file_sizes(paths: list[str | None]) -> list[int | None]:
    """Bytes of each file; None where there is none."""
    sizes: list[int | None] = [None] * len(paths)
    for i, path in enumerate(paths):
        if path is not None:
            system, inner = locate(path)
            info = system.get_file_info(inner)
            sizes[i] = info.size if info.type == pafs.FileType.File else None
    return sizes


def read_file(path: str) -> bytes:
    system, inner = locate(path)
    with system.open_input_stream(inner, compression=None) as handle:
        return handle.read()


def write_file(path: str, content: bytes, made: set[str] | None = None) -> None:
    """Write beside the place and move there, so a task that is lost or run twice leaves a whole file or none.

    ``made`` are folders known to be there; the file's own is added.
    """
    system, inner = locate(path)
    folder = inner.rpartition("/")[0]
    if made is None or folder not in made:
        system.create_dir(folder, recursive=True)
        if made is not None:
            made.add(folder)
    beside = f"{inner}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(beside, compression=None) as handle:
        handle.write(content)
    system.move(beside, inner)
