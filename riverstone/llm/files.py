"""Files in the shared store from tasks: the store's own URI through Arrow's file systems (local, HDFS, S3, GCS)."""

from __future__ import annotations

import contextlib
import os
import uuid
from collections.abc import Iterator

import pyarrow.fs as pafs


def store(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


@contextlib.contextmanager
def write_whole(uri: str) -> Iterator:
    """A file that appears under its name only when it is complete; a repeated task puts the same file in its place."""
    fs, path = store(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    try:
        with fs.open_output_stream(part, compression=None) as out:
            yield out
        fs.move(part, path)
    except BaseException:
        with contextlib.suppress(OSError):
            fs.delete_file(part)
        raise


def open_stream(uri: str):  # noqa: ANN201
    fs, path = store(uri)
    return fs.open_input_stream(path, compression=None)


def open_file(uri: str):  # noqa: ANN201
    """For reading at any place."""
    fs, path = store(uri)
    return fs.open_input_file(path)
