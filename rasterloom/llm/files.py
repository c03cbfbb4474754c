"""Files of a task's own format in a shared folder.

A task writes under a fresh name and reports it in a manifest row. The manifest is a
table that Spark commits, so files of lost or repeated attempts are never read.
"""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of ``path`` (a URI or an absolute path), and the path in it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if path.startswith("/"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def partition_id() -> int:
    context = TaskContext.get()
    return context.partitionId() if context else 0


def new_file(folder: str, suffix: str) -> str:
    """A name that no other attempt uses."""
    return f"{folder}/{partition_id():06d}-{uuid.uuid4().hex[:12]}{suffix}"


def spread(manifest: DataFrame, most: int = 4096) -> DataFrame:
    """About one file to each task."""
    files = manifest.count()
    return manifest.repartition(max(1, min(files, most))) if files > 1 else manifest


def total_before(manifest: DataFrame, count: str, order: list[str], out: str) -> DataFrame:
    """``out``: the sum of ``count`` over the files before each (one row a file)."""
    from pyspark.sql import Window

    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn(out, F.coalesce(F.sum(count).over(before), F.lit(0)))
