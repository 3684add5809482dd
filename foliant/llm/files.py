"""Binary files that tasks write to and read from the cluster's shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from foliant.session import checkpoint_folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own below the shared folder of the session."""
    return f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def open_place(folder: str):
    """(file system, path in it) of a folder given as URI or absolute path, in the task that asks."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def attempt_name(stem: str, suffix: str) -> str:
    """A file name that no other attempt of the task uses, so a file left by a lost executor is never taken for a whole one:
    only names in the rows of a finished task are read."""
    from pyspark import TaskContext

    return f"{stem}-{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex[:8]}{suffix}"
