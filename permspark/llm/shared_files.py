"""Files that tasks write to and read from a folder which driver and executors share."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI; a bare path is a local one."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


@contextlib.contextmanager
def published(uri: str) -> Iterator[pa.NativeFile]:
    """A file that appears under its name only when it is whole. A task that runs again writes the same file again."""
    system, path = located(uri)
    context = TaskContext.get()
    own = f"{path}.{context.taskAttemptId() if context else 0}.part"
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(own) as out:
        yield out
    try:
        system.move(own, path)
    except OSError:  # some stores don't overwrite
        if system.get_file_info(path).type == fs.FileType.NotFound:
            raise
        system.delete_file(path)
        system.move(own, path)


def partition() -> int:
    context = TaskContext.get()
    return context.partitionId() if context else 0
