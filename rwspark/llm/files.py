"""Binary files in the shared folder, written once by the task that commits first."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator
from typing import IO


def filesystem(path: str):
    """(file system, path in it) of a URI or a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path) if not path.startswith("file:/") or path.startswith("file://") else fs.FileSystem.from_uri("file://" + path[5:])


@contextlib.contextmanager
def committed(folder: str, name: str) -> Iterator[IO[bytes]]:
    """A stream to ``folder/name``. A task that is run again, or twice at once, writes under its own name and then moves the file; all attempts write the same bytes."""
    from pyspark import TaskContext

    store, base = filesystem(folder)
    task = TaskContext.get()
    own = f"{base}/.{name}.{task.taskAttemptId() if task else 0}"
    store.create_dir(base, recursive=True)
    with store.open_output_stream(own, compression=None) as out:
        yield out
    store.move(own, f"{base}/{name}")


def opened(path: str, buffer_size: int = 1 << 20):
    """A buffered stream to read a file from its start."""
    store, at = filesystem(path)
    return store.open_input_stream(at, compression=None, buffer_size=buffer_size)
