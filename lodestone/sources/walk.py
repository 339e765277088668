"""A Spark source that lists a tree of folders in parallel and never opens the ones that are ruled out."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator
from contextlib import AbstractContextManager

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition, Not, StringContains, StringStartsWith
from pyspark.sql.types import StructType

#: Folders waiting from which the driver stops listing and tasks go on.
SPREAD = 256
#: Bytes of contents in one batch.
BATCH = 16 << 20

Scan = Callable[[str], AbstractContextManager[Iterable[os.DirEntry]]]
Entry = tuple[str, int | None, int | None, bool]


class Folders(InputPartition):
    def __init__(self, names: list[str], rows: list[Entry]):
        self.names, self.rows = names, rows


class Walk(DataSourceReader):
    """Lists (path, ms, size, link) below a root. Filters on ``path`` that say how it begins, or what it must not begin with or
    hold, decide for a whole folder before it is opened; Spark applies them to the files as well."""

    def __init__(self, root: str, ignored: set[str], scan: Scan = os.scandir):
        self.root, self.ignored, self.scan = root, ignored, scan
        self.begins: list[str] = []
        self.never: list[str] = []
        self.without: list[str] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            inner = f.child if isinstance(f, Not) else f
            if getattr(inner, "attribute", None) == ("path",):
                if isinstance(f, (StringStartsWith, EqualTo)):
                    self.begins.append(f.value)
                elif isinstance(inner, StringStartsWith):
                    self.never.append(inner.value)
                elif isinstance(inner, StringContains):
                    self.without.append(inner.value)
            yield f

    def _open(self, folder: str) -> bool:
        below = folder + "/"
        if folder.rpartition("/")[2] in self.ignored or any(below.startswith(p) for p in self.never) or any(x in below for x in self.without):
            return False
        return all(below.startswith(p) or p.startswith(below) for p in self.begins)

    def list(self, folder: str) -> tuple[list[str], list[Entry]]:
        """(folders to open, rows) of one folder; one that cannot be read has none. Links are rows and are not followed."""
        folders: list[str] = []
        rows: list[Entry] = []
        try:
            with self.scan(os.path.join(self.root, folder) if folder else self.root) as found:
                for entry in found:
                    path = f"{folder}/{entry.name}" if folder else entry.name
                    if entry.is_symlink():
                        if entry.name not in self.ignored or not entry.is_dir():
                            rows.append((path, None, None, True))
                    elif entry.is_dir(follow_symlinks=False):
                        if self._open(path):
                            folders.append(path)
                    elif entry.is_file(follow_symlinks=False):
                        try:
                            about = entry.stat(follow_symlinks=False)
                        except FileNotFoundError:
                            continue
                        rows.append((path, about.st_mtime_ns // 1_000_000, about.st_size, False))
        except (PermissionError, FileNotFoundError, NotADirectoryError):
            if not folder:
                raise
        return folders, rows

    def partitions(self) -> list[InputPartition]:
        """Level by level until there are folders enough to deal; what was seen on the way goes with them."""
        waiting, seen = [""], []
        while waiting and len(waiting) < SPREAD and len(seen) < 100 * SPREAD:
            level, waiting = waiting, []
            for at, folder in enumerate(level):
                folders, rows = self.list(folder)
                waiting += folders
                seen += rows
                if len(waiting) >= SPREAD or len(seen) >= 100 * SPREAD:
                    waiting += level[at + 1 :]
                    break
        n = max(1, min(SPREAD, len(waiting)))
        return [Folders(waiting[k::n], seen[k::n]) for k in range(n)]

    def read(self, partition: Folders) -> Iterator[Entry]:
        yield from partition.rows
        waiting = list(partition.names)
        while waiting:
            folders, rows = self.list(waiting.pop())
            waiting += folders
            yield from rows


class TreeSource(DataSource):
    """``spark.read.format("lodestone_tree")`` with ``root``, a folder that driver and executors see, and ``ignored``, names of folders
    apart by slashes. Rows: path below the root, ms (modification time), size, link."""

    @classmethod
    def name(cls) -> str:
        return "lodestone_tree"

    def schema(self) -> str:
        return "path string, ms long, size long, link boolean"

    def reader(self, schema: StructType) -> DataSourceReader:
        return Walk(self.options["root"], {x for x in self.options.get("ignored", "").split("/") if x})


def listing(spark, root: str, ignored: Iterable[str]) -> DataFrame:
    """(path, ms, size, link) of a tree. Turns on Spark's handing of filters to such sources, which only these sources heed."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TreeSource)
    return spark.read.format("lodestone_tree").option("root", root).option("ignored", "/".join(sorted(ignored))).load()


def contents(files: DataFrame, root: str) -> DataFrame:
    """``files`` (path, mtime, size) with ``content``, null where a file cannot be read any more; files are dealt out anew, since the
    folders that tasks listed may hold very different numbers of them."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, held, found = 0, 0, []
            for at, path in enumerate(batch.column(0).to_pylist()):
                try:
                    with open(os.path.join(root, path), "rb") as file:
                        found.append(file.read())
                except OSError:
                    found.append(None)
                held += len(found[-1] or b"")
                if held >= BATCH or at + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([*batch.slice(begin, len(found)).columns, pa.array(found, pa.binary())], names=[*batch.schema.names, "content"])
                    begin, held, found = at + 1, 0, []

    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)
    return files.repartition(parts, "path").mapInArrow(read, f"{kinds}, content binary")
