"""Data sources over what a fetcher has landed: listing pages, and files of stream messages.

After ``register(spark)``:

- ``spark.read.format("landed_pages").load(folder)``: run, page, value. A run is a folder ``run=...`` with a file
  for each page, ``page=<n>.json``; a partition for each run. ``pages.parsed`` makes pages of the values.
- ``spark.readStream.format("landed_messages").load(folder)`` (or ``spark.read``): file, ord, value. Files have a message a
  line and names that grow, as times do; a file must be whole when it appears and may not change. A partition for each
  file. ``ord`` is the file's number among all, times 2**32, and the line's; it grows over all messages.

An offset is the name of the last file taken and how many there were, so a batch that runs again after a failure
has the same files with the same numbers: nothing is lost or doubled. With the option ``archive``, files are moved to that
folder once Spark has committed the batch they were in. A file that appears under a name that isn't larger than
those already taken is never read. Paths are local ones or URIs that Arrow's file systems know.

Empty lines are left out, empty folders and missing ones give no rows; names that don't fit are other files.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

PAGES, MESSAGES = "run string, page long, value string", "file string, ord long, value string"
_ROWS = 1000


def _opened(path: str):
    """The file system of a path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+.-]+:/", path) else (fs.LocalFileSystem(), path)


def _files(path: str, deep: bool) -> list[str]:
    """The files below a folder, as paths in its file system; hidden ones are left out."""
    from pyarrow import fs

    system, root = _opened(path)
    found = system.get_file_info(fs.FileSelector(root.rstrip("/"), recursive=deep, allow_not_found=True))
    return sorted(f.path for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))


def _text(path: str, file: str) -> str:
    system, _ = _opened(path)
    with system.open_input_stream(file) as data:
        return data.read().decode("utf-8", "replace")


class _Parts(InputPartition):
    """Files (number, path) that a task reads."""

    def __init__(self, files: list[tuple[int, str]]):
        self.files = files


class _PageReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[_Parts]:
        runs: dict[str, list[tuple[int, str]]] = {}
        for file in _files(self.path, True):
            if found := re.search(r"/run=([^/]*)/page=(\d+)\.json$", file):
                runs.setdefault(found[1], []).append((int(found[2]), file))
        return [_Parts(sorted(files)) for files in runs.values()] or [_Parts([])]

    def read(self, partition: _Parts) -> Iterator[tuple]:
        for page, file in partition.files:
            yield re.search(r"/run=([^/]*)/page=", file)[1], page, _text(self.path, file)


class LandedPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "landed_pages"

    def schema(self) -> str:
        return PAGES

    def reader(self, schema) -> DataSourceReader:
        return _PageReader(self.options["path"])


def _messages(path: str, partition: _Parts) -> Iterator[pa.RecordBatch]:
    for number, file in partition.files:
        lines = [(number << 32 | at, line) for at, line in enumerate(_text(path, file).split("\n")) if line.strip()]
        for at in range(0, len(lines), _ROWS):
            part = lines[at : at + _ROWS]
            name = file.rsplit("/", 1)[-1]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array([n for n, _ in part], pa.int64()), pa.array([x for _, x in part])], names=["file", "ord", "value"])


class _MessageReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[_Parts]:
        return [_Parts([x]) for x in enumerate(_files(self.path, False))] or [_Parts([])]

    def read(self, partition: _Parts) -> Iterator[pa.RecordBatch]:
        return _messages(self.path, partition)


class _MessageStream(DataSourceStreamReader):
    def __init__(self, path: str, archive: str | None):
        self.path, self.archive = path, archive

    def _all(self) -> dict[str, str]:
        """Where each file is, by name: those that wait and those that are archived."""
        found = [f for folder in (self.archive, self.path) if folder for f in _files(folder, False)]
        return dict(sorted((f.rsplit("/", 1)[-1], f) for f in found))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"file": "", "n": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        names = list(self._all())
        return {"file": names[-1], "n": len(names)} if names else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[_Parts]:
        files = [path for name, path in self._all().items() if start["file"] < name <= end["file"]]
        return [_Parts([(start["n"] + at, f)]) for at, f in enumerate(files)] or [_Parts([])]

    def read(self, partition: _Parts) -> Iterator[pa.RecordBatch]:
        return _messages(self.path, partition)

    def commit(self, end: dict) -> None:
        if self.archive:
            system, _ = _opened(self.path)
            _, folder = _opened(self.archive)
            system.create_dir(folder, recursive=True)
            for file in _files(self.path, False):
                if file.rsplit("/", 1)[-1] <= end["file"]:
                    system.move(file, f"{folder.rstrip('/')}/{file.rsplit('/', 1)[-1]}")


class LandedMessages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "landed_messages"

    def schema(self) -> str:
        return MESSAGES

    def reader(self, schema) -> DataSourceReader:
        return _MessageReader(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _MessageStream(self.options["path"], self.options.get("archive"))


def register(spark: SparkSession) -> None:
    for source in (LandedPages, LandedMessages):
        spark.dataSource.register(source)
