"""Binary files in the shared folder, written and read by tasks through Arrow's file systems."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyarrow import fs
from pyspark import SparkContext


def qualified(sc: SparkContext, path: str) -> str:
    """``path`` with the scheme of the cluster's default file system where it has none."""
    if "://" in path or path.startswith("file:"):
        return path
    hadoop = sc._jvm.org.apache.hadoop.fs
    return hadoop.Path(path).getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(hadoop.Path(path)).toString()


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


@contextmanager
def written(uri: str):
    """A stream whose file appears under ``uri`` once it is whole; a lost attempt leaves none."""
    system, path = opened(uri)
    folder, _, name = path.rpartition("/")
    system.create_dir(folder, recursive=True)
    attempt = f"{folder}/.{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(attempt) as out:
        yield out
    system.move(attempt, path)
