"""Files that tasks open themselves, by URI: file:, hdfs:, s3: and what else pyarrow knows.

A path without a scheme is on this machine's file system; on a cluster that has to be a mount that all
executors share.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager
from typing import BinaryIO

from pyarrow import fs

_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]+:")


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if _SCHEME.match(path):
        return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return fs.LocalFileSystem(), path


def names(folder: str, suffix: str) -> list[str]:
    """The names in a folder that end so, sorted."""
    system, at = located(folder)
    found = system.get_file_info(fs.FileSelector(at, allow_not_found=True))
    return sorted(f.base_name for f in found if f.type == fs.FileType.File and f.base_name.endswith(suffix) and not f.base_name.startswith("."))


def read(path: str) -> bytes:
    system, at = located(path)
    with system.open_input_file(at) as f:
        return f.read()


@contextmanager
def opened(path: str) -> Iterator[BinaryIO]:
    """A file for reading, of which places can be sought."""
    system, at = located(path)
    with system.open_input_file(at) as f:
        yield f


@contextmanager
def written(path: str) -> Iterator[BinaryIO]:
    """A file that is there under its name only once it is whole."""
    import uuid

    system, at = located(path)
    folder, _, name = at.rpartition("/")
    if folder:
        system.create_dir(folder, recursive=True)
    part = f"{folder}/.{name}.{uuid.uuid4().hex}" if folder else f".{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(part) as f:
        yield f
    system.move(part, at)
