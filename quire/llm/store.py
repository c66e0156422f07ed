"""Binary files in the shared folder, opened from the executors through Arrow's file systems.

Files carry the name of the task attempt that wrote them; a manifest of rows, written by Spark, lists those of the
attempts that counted, so that a lost executor or a second attempt leaves nothing wrong behind.
"""

from __future__ import annotations

import uuid

from pyarrow import fs


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI (file:, hdfs:, s3:, gs:, or a plain path) and the path in it."""
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def attempt_name(suffix: str) -> str:
    from pyspark import TaskContext

    task = TaskContext.get()
    return f"part-{task.partitionId() if task else 0:06d}-{uuid.uuid4().hex}{suffix}"


def new_file(folder: str, suffix: str):
    """(path as URI, output stream) of a new file in a folder, which is made if it is missing."""
    system, path = filesystem(folder)
    system.create_dir(path, recursive=True)
    name = attempt_name(suffix)
    return f"{folder}/{name}", system.open_output_stream(f"{path}/{name}", compression=None)


def open_range(uri: str, offset: int):
    """A seekable input file at an offset."""
    system, path = filesystem(uri)
    f = system.open_input_file(path)
    f.seek(offset)
    return f
