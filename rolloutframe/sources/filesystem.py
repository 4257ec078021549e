"""Named files below a folder that any of Arrow's file systems reaches: local, hdfs, s3, gs."""

from __future__ import annotations

import io
import os
import posixpath
from functools import lru_cache

from pyarrow import fs


@lru_cache(maxsize=64)
def filesystem(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder[5:].lstrip("/")
    if "://" not in folder:
        return fs.LocalFileSystem(), posixpath.join(os.getcwd(), folder)
    return fs.FileSystem.from_uri(folder)


def entries(folder: str) -> tuple[list[str], list[str]]:
    """The files and the folders right in ``folder``, as paths of its file system; hidden ones are left out."""
    system, base = filesystem(folder)
    found = [f for f in system.get_file_info(fs.FileSelector(base)) if not f.base_name.startswith((".", "_"))]
    return tuple(sorted(f.path for f in found if f.type == kind) for kind in (fs.FileType.File, fs.FileType.Directory))


def listed(folder: str, suffix: str, below: str | None = None) -> list[str]:
    """The files below ``folder``, or below a folder in it that ``entries`` found, whose names end in ``suffix``, as paths of its file system."""
    system, base = filesystem(folder)
    base = below or base
    return sorted(f.path for f in system.get_file_info(fs.FileSelector(base, recursive=True)) if f.type == fs.FileType.File and f.path.endswith(suffix))


def opened(folder: str, path: str) -> io.IOBase:
    """A file that ``listed`` found, for reading anywhere in it."""
    return filesystem(folder)[0].open_input_file(path)


@lru_cache(maxsize=1024)
def _created(folder: str, below: str) -> None:
    """Make a folder, once a process."""
    filesystem(folder)[0].create_dir(below, recursive=True)


def written(folder: str, name: str, content: bytes) -> str:
    """Write a file below ``folder``; a name that would leave it is an error."""
    system, base = filesystem(folder)
    target = posixpath.normpath(posixpath.join(base, name))
    if not target.startswith(base.rstrip("/") + "/"):
        raise ValueError(f"no file name: {name}")
    _created(folder, posixpath.dirname(target))
    with system.open_output_stream(target) as out:
        out.write(content)
    return target
