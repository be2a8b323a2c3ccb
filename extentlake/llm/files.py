"""Files in the shared folder, on any store that pyarrow opens by a URI (file, hdfs, s3, gs)."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs


def store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def make_folder(uri: str) -> None:
    system, path = store(uri)
    system.create_dir(path, recursive=True)


@contextmanager
def whole(uri: str) -> Iterator:
    """A stream to a new file that shows under its name only when it is whole: a task that runs twice does no harm."""
    system, path = store(uri)
    hidden = f"{path}.{uuid.uuid4().hex}"
    with system.open_output_stream(hidden) as out:
        yield out
    system.move(hidden, path)


def opened(uri: str):
    """A file to read at any place."""
    system, path = store(uri)
    return system.open_input_file(path)


def content(uri: str) -> bytes:
    with opened(uri) as f:
        return f.read()
