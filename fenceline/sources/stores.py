"""Files below a root, as tasks see them: local or shared mounts, HDFS, object stores."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator

import pyarrow.fs as pafs


def store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return pafs.FileSystem.from_uri(path) if re.match(r"\w+:/", path) else (pafs.LocalFileSystem(), os.path.abspath(path))


def join(root: str, path: str) -> str:
    return root.rstrip("/") + "/" + path if path else root


def children(root: str, directory: str) -> Iterator[tuple[str, bool, int]]:
    """(path below root, is a directory, size) of what a directory holds. Links are followed; broken ones, and links to a directory
    that they stand in, are left out. A directory that is gone, or may not be read, holds nothing."""
    fs, base = store(root)
    here = join(base, directory)
    try:
        entries = fs.get_file_info(pafs.FileSelector(here, recursive=False))
    except (FileNotFoundError, PermissionError, NotADirectoryError):
        return
    local = isinstance(fs, pafs.LocalFileSystem)
    for e in entries:
        path = f"{directory}/{e.base_name}" if directory else e.base_name
        if local and os.path.islink(e.path):
            real = os.path.realpath(e.path)
            if not os.path.exists(real) or (os.path.realpath(here) + "/").startswith(real.rstrip("/") + "/"):
                continue
            folder = os.path.isdir(real)
            yield path, folder, 0 if folder else os.path.getsize(real)
        elif e.type in (pafs.FileType.Directory, pafs.FileType.File):
            yield path, e.type == pafs.FileType.Directory, e.size or 0


def read(root: str, path: str) -> bytes | None:
    """What a file holds; null if there is none."""
    fs, base = store(root)
    try:
        with fs.open_input_stream(join(base, path), compression=None) as f:
            return f.read()
    except (FileNotFoundError, IsADirectoryError):
        return None


def chunks(root: str, path: str, size: int = 1 << 20) -> Iterator[bytes]:
    """What a file holds, piece by piece."""
    fs, base = store(root)
    with fs.open_input_stream(join(base, path), compression=None) as f:
        while data := f.read(size):
            yield data


def part_name(path: str) -> str:
    """A name beside ``path`` for a file that is not whole yet; no listing of sources takes it up."""
    folder, _, name = path.rpartition("/")
    return f"{folder}/.{name}.{uuid.uuid4().hex}.part" if folder else f".{name}.{uuid.uuid4().hex}.part"


def write(root: str, path: str, pieces: Iterator[bytes]) -> None:
    """Write a file as a stream; its directories are made."""
    fs, base = store(root)
    target = join(base, path)
    fs.create_dir(target.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(target, compression=None) as f:
        for p in pieces:
            f.write(p)


def exists(root: str, path: str) -> bool:
    fs, base = store(root)
    return fs.get_file_info(join(base, path)).type != pafs.FileType.NotFound


def move(root: str, source: str, target: str) -> None:
    """Rename a file over another; done twice, the second time finds nothing to do."""
    fs, base = store(root)
    a, b = join(base, source), join(base, target)
    if fs.get_file_info(a).type == pafs.FileType.NotFound and fs.get_file_info(b).type != pafs.FileType.NotFound:
        return
    fs.create_dir(b.rpartition("/")[0], recursive=True)
    fs.move(a, b)


def delete(root: str, path: str) -> None:
    """Delete a file, if it is there."""
    fs, base = store(root)
    try:
        fs.delete_file(join(base, path))
    except FileNotFoundError:
        pass


def delete_directory(root: str, path: str) -> None:
    """Delete a directory and what is in it, if it is there."""
    fs, base = store(root)
    try:
        fs.delete_dir(join(base, path))
    except FileNotFoundError:
        pass
