"""Listings of folders as a data source: tables and streams of files, without reading any.

``spark.read.format("file_listing").option("root", ...)`` after ``register``. Options: ``root``;
``paths`` and ``skip``, JSON lists of folders below it; ``parts``, how many tasks at least are fed.
"""

from __future__ import annotations

import datetime
import json
import os
import time
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .tables import JPEG, OTHER_IMAGES, RAW, VIDEO

LISTED = "path string, size long, modified timestamp, extension string, supported boolean"


def entries(folder: str) -> Iterator[tuple[str, bool, int, float]]:
    """(path, whether a folder, size, modified) of what lies in a folder. Links are left out; a
    folder that can't be listed is an error, never an empty one."""
    if "://" not in folder:
        with os.scandir(folder) as found:
            for e in found:
                if not e.is_symlink():
                    s = e.stat(follow_symlinks=False)
                    yield e.path, e.is_dir(follow_symlinks=False), s.st_size, s.st_mtime
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    scheme = folder.split("://")[0]
    for i in store.get_file_info(fs.FileSelector(path)):
        yield f"{scheme}://{i.path}", i.type == fs.FileType.Directory, i.size or 0, (i.mtime_ns or 0) / 1e9


class Folders(InputPartition):
    """Folders to list with all below them (``deep``) or alone, and times within which files count."""

    def __init__(self, deep: list[str], alone: list[str], after: float, until: float):
        self.deep, self.alone, self.after, self.until = deep, alone, after, until


class Listing:
    """What batch and stream readers share."""

    def __init__(self, options: dict[str, str]):
        root = options.get("root", "")
        self.root = os.path.realpath(root.removeprefix("file://")) if root.startswith(("/", "file://")) else root.rstrip("/")
        names = json.loads(options.get("paths") or '[""]')
        self.chosen = sorted({self._below(p) for p in names})
        self.skip = {self._below(p) for p in json.loads(options.get("skip") or "[]")}
        self.parts = int(options.get("parts", 32))

    def _below(self, name: str) -> str:
        path = os.path.normpath(f"{self.root}/{name.strip('/')}") if "://" not in self.root else f"{self.root}/{name.strip('/')}".rstrip("/")
        if ".." in name.split("/") or not (path == self.root or path.startswith(self.root + "/")):
            raise ValueError(f"{name} lies outside {self.root}")
        return path

    def partitions_of(self, after: float, until: float) -> list[Folders]:
        """The first folders are listed here until there are enough to deal out; a folder chosen
        twice, or below another one, is listed once."""
        todo = [c for c in self.chosen if not any(c.startswith(o + "/") for o in self.chosen) and c not in self.skip]
        alone: list[str] = []
        while todo and len(todo) < 8 * self.parts and len(alone) < 8 * self.parts:
            folder = todo.pop(0)
            alone.append(folder)
            todo += [p for p, is_folder, _, _ in entries(folder) if is_folder and p not in self.skip]
        n = min(self.parts, max(1, len(todo) + len(alone)))
        return [Folders(todo[i::n], alone[i::n], after, until) for i in range(n)]

    def read(self, partition: Folders) -> Iterator[tuple]:
        known = {*JPEG, *RAW, *OTHER_IMAGES, *VIDEO}
        todo = [(f, True) for f in partition.deep] + [(f, False) for f in partition.alone]
        while todo:
            folder, deep = todo.pop()
            for path, is_folder, size, modified in entries(folder):
                if is_folder:
                    if deep and path not in self.skip:
                        todo.append((path, True))
                elif partition.after < modified <= partition.until:
                    name = path.rsplit("/", 1)[-1]
                    extension = "." + name.rsplit(".", 1)[1].lower() if "." in name else ""
                    yield path, size, datetime.datetime.fromtimestamp(modified, datetime.timezone.utc), extension, extension in known


class ListingReader(Listing, DataSourceReader):
    def partitions(self) -> list[Folders]:
        return self.partitions_of(float("-inf"), float("inf"))


class ListingStream(Listing, DataSourceStreamReader):
    """Files by the time they were modified. A file that is moved in with an older time than what was
    read is not seen; a listing as a table finds it."""

    def initialOffset(self) -> dict:
        return {"until": 0.0}

    def latestOffset(self) -> dict:
        return {"until": time.time()}

    def partitions(self, start: dict, end: dict) -> list[Folders]:
        return self.partitions_of(start["until"], end["until"])

    def commit(self, end: dict) -> None:
        pass


class FileListing(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_listing"

    def schema(self) -> str:
        return LISTED

    def reader(self, schema) -> ListingReader:
        return ListingReader(self.options)

    def streamReader(self, schema) -> ListingStream:
        return ListingStream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FileListing)
