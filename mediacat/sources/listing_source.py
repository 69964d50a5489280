"""SRC-1 as a Python data source: ``spark.read.format("file_listing")``.

Planning looks at the upper directories only, level by level, until a level
has enough subdirectories for the wanted number of tasks or a bounded number of
entries was seen. There each directory is cut into slices of names, and a task
takes the files and the whole subtrees of one slice; so there are about as many
tasks as wanted, however many directories a level has. Above, a directory becomes
tasks for its own files (a very wide directory is so dealt over many tasks). A
task follows directory iterators, so its memory depends on the depth of the tree
and not on the width of a directory, and hands Arrow batches to Spark.

Filters on the start of ``path`` (a folder) and on its end (an extension) are
pushed down: folders that cannot hold a match are not opened, and files that do
not match are not asked for their size.

Options: ``root``, ``strip_prefix`` (cut off the paths), ``tasks`` (about how
many), ``slice`` (entries of a slice).
"""

from __future__ import annotations

import os
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, InputPartition, IsNotNull, StringEndsWith, StringStartsWith

from .files import LISTING_FRAME, TICKS_AT_UNIX_EPOCH, fs_and_path

NAME = "file_listing"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
SLICE = 100_000
#: entries that planning looks at, about
PLANNED = 1_000_000

_SCHEMA = pa.schema([("path", pa.string()), ("file_size", pa.int64()), ("mtime_ticks", pa.int64())])


@dataclass
class Entry:
    path: str
    is_dir: bool
    stat: object  # () -> (size, ticks or None)


def entries(directory: str) -> Iterator[Entry]:
    """The direct children of a directory, one after the other; none if it is
    gone. Local and mounted file systems hand them out one by one, others in
    one list for each directory. A file that goes meanwhile is left out."""
    filesystem, base = fs_and_path(directory)
    if isinstance(filesystem, fs.LocalFileSystem):
        try:
            found = os.scandir(base)
        except (FileNotFoundError, NotADirectoryError):
            return
        with found:
            for e in found:
                yield Entry(f"{directory.rstrip('/')}/{e.name}", e.is_dir(), lambda e=e: _local_stat(e))
        return
    for info in filesystem.get_file_info(fs.FileSelector(base, allow_not_found=True)):
        path = directory.rstrip("/") + "/" + info.path[len(base.rstrip("/")) :].lstrip("/")
        ticks = None if info.mtime_ns is None else info.mtime_ns // 100 + TICKS_AT_UNIX_EPOCH
        yield Entry(path, info.type == fs.FileType.Directory, lambda at=(info.size, ticks): at)


def _local_stat(entry: os.DirEntry) -> tuple[int, int] | None:
    try:
        stat = entry.stat()
    except FileNotFoundError:
        return None
    return stat.st_size, stat.st_mtime_ns // 100 + TICKS_AT_UNIX_EPOCH


@dataclass
class Part(InputPartition):
    """The files of one directory whose names fall into slice ``slice`` of
    ``slices``, where ``deep`` with the subtrees of the directories whose names
    do; without slices its whole subtree."""

    directory: str
    slice: int = 0
    slices: int = 0
    deep: bool = False


class ListingReader(DataSourceReader):
    def __init__(self, options: dict):
        root = options.get("root")
        if not root:
            raise ValueError("option root is missing")
        self.root = _local(root).rstrip("/") or "/"
        self.strip = _local(options.get("strip_prefix", ""))
        self.tasks, self.slice = int(options.get("tasks", 64)), int(options.get("slice", SLICE))
        self.starts: list[str] = []
        self.ends: list[str] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, StringStartsWith) and f.attribute == ("path",):
                self.starts.append(f.value)
            elif isinstance(f, StringEndsWith) and f.attribute == ("path",):
                self.ends.append(f.value)
            elif not (isinstance(f, IsNotNull) and f.attribute == ("path",)):  # every row has a path
                yield f

    def _shown(self, path: str) -> str:
        return path[len(self.strip) :] if self.strip and path.startswith(self.strip) else path

    def _wanted(self, path: str) -> bool:
        shown = self._shown(path)
        return all(shown.startswith(s) for s in self.starts) and all(shown.endswith(e) for e in self.ends)

    def _may_hold(self, directory: str) -> bool:
        """Whether a path below the directory can have the wanted starts."""
        inside = self._shown(directory.rstrip("/") + "/")
        return all(inside.startswith(s) or s.startswith(inside) for s in self.starts)

    def partitions(self) -> list[Part]:
        level, out, seen = [self.root], [], 0
        while level and len(level) + len(out) < self.tasks and seen < PLANNED:
            looked: list[tuple[str, int, int]] = []  # directory, files, directories in it
            below: list[str] = []
            for directory in level:
                if seen >= PLANNED:
                    break
                files = dirs = 0
                for e in entries(directory):
                    seen += 1
                    if not e.is_dir:
                        files += 1
                    elif self._may_hold(e.path):
                        dirs += 1
                        if len(below) < self.tasks:  # more are not looked at one by one
                            below.append(e.path)
                looked.append((directory, files, dirs))
            rest = level[len(looked) :]
            if len(below) >= self.tasks or rest:
                return out + self._sliced(looked, rest)
            out += [part for directory, files, _ in looked for part in self._slices(directory, -(-files // self.slice), False)]
            level = below
        return [*out, *[Part(d) for d in level]] or [Part(self.root)]  # Spark asks for one at least

    @staticmethod
    def _slices(directory: str, slices: int, deep: bool) -> list[Part]:
        return [Part(directory, i, slices, deep) for i in range(slices)]

    def _sliced(self, looked: list[tuple[str, int, int]], rest: list[str]) -> list[Part]:
        """The subtrees of a level, slices in proportion to the directories that
        each holds; those in ``rest``, not looked at, count as the mean."""
        total = sum(dirs for _, _, dirs in looked)
        mean = -(-total // len(looked))
        total = max(total + mean * len(rest), 1)
        cut = [(d, max(-(-files // self.slice), -(-self.tasks * dirs // total)), dirs > 0) for d, files, dirs in looked]
        cut += [(d, max(-(-self.tasks * mean // total), 1), True) for d in rest]
        return [part for directory, slices, deep in cut for part in self._slices(directory, slices, deep)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for e in self._files(part.directory, part.slice, part.slices, part.deep):
            stat = e.stat()
            if stat is not None:
                rows.append((self._shown(e.path), *stat))
            if len(rows) == LISTING_FRAME:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)

    def _files(self, directory: str, slice_: int = 0, slices: int = 0, deep: bool = True) -> Iterator[Entry]:
        for e in entries(directory):
            if slices > 1 and zlib.crc32(os.fsencode(e.path.rpartition("/")[2])) % slices != slice_:
                continue
            if e.is_dir:
                if (deep or not slices) and self._may_hold(e.path):
                    yield from self._files(e.path)
            elif self._wanted(e.path):
                yield e


def _local(uri: str) -> str:
    return uri[len("file:") :] if uri.startswith("file:") else uri


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _SCHEMA.types)], schema=_SCHEMA)


class FileListing(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "path string, file_size long, mtime_ticks long"

    def reader(self, schema) -> ListingReader:
        return ListingReader(dict(self.options))


def read_listing(spark: SparkSession, root: str, strip_prefix: str | None = None, tasks: int | None = None, slice_entries: int = SLICE) -> DataFrame:
    """Every file below ``root``: the rows of :func:`mediacat.sources.files.list_files`,
    read through the data source, which is registered with the session."""
    if spark.conf.get(PUSHDOWN, "false") != "true":
        spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(FileListing)
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    reader = spark.read.format(NAME).option("root", root).option("tasks", tasks).option("slice", slice_entries)
    return (reader if strip_prefix is None else reader.option("strip_prefix", strip_prefix)).load()
