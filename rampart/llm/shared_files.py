"""Files in the shared folder that ``spark.checkpoint.dir`` names, from driver and tasks."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from rampart.session import scratch_path


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder (as a URI or path) for one run's files."""
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


def _fs(uri: str):
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    return fs.FileSystem.from_uri(uri)


class Publish:
    """A file written under a private name and moved into place when complete, so a task that
    runs twice (retry, speculation) leaves one whole file."""

    def __init__(self, folder: str, name: str):
        self.uri = f"{folder}/{name}"
        self.fs, self.path = _fs(self.uri)
        self.temp = f"{self.path}.{uuid.uuid4().hex}.tmp"

    def __enter__(self):
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.out = self.fs.open_output_stream(self.temp)
        return self.out

    def __exit__(self, kind, *_):
        self.out.close()
        if kind is None:
            self.fs.move(self.temp, self.path)
        else:
            self.fs.delete_file(self.temp)


def open_file(uri: str):
    """A readable, seekable file."""
    f, path = _fs(uri)
    return f.open_input_file(path)
