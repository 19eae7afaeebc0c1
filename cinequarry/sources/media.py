"""Data sources for media folders and edit lists.

``spark.read.format("media_files")`` lists files in tasks: the driver reads
the top of the folder alone, and each folder below it is walked where Spark
runs the partition, with filters on size, time and extension applied as files
are met. The same source streams new files. ``df.write.format("edit_lists")``
writes one file a list, all or none. Paths must be mounted on every executor,
as media folders are.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    DataSourceWriter,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)
from pyspark.sql.types import Row, StructType

FILES = "path string, size long, modified_ns long, extension string"
_COLUMNS = ("path", "size", "modified_ns", "extension")
_TESTS = {EqualTo: lambda a, b: a == b, In: lambda a, b: a in b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b}


@dataclass
class Folder(InputPartition):
    """A folder to walk, or with ``deep`` off only its own files; times are those after ``after`` up to ``until``."""

    path: str
    deep: bool = True
    after: int = -1
    until: int | None = None


def _file_row(entry: os.DirEntry) -> tuple[str, int, int, str]:
    told = entry.stat(follow_symlinks=False)
    _, dot, extension = entry.name.rpartition(".")
    return entry.path, told.st_size, told.st_mtime_ns, extension.lower() if dot else ""


def walk(folder: Folder) -> Iterator[tuple[str, int, int, str]]:
    """Rows of FILES of regular files with content, in order of name; links are not followed, a folder that goes meanwhile is empty."""
    todo = [folder.path]
    while todo:
        try:
            with os.scandir(todo.pop()) as found:
                entries = sorted(found, key=lambda e: e.name)
        except FileNotFoundError:
            continue
        for e in entries:
            if e.is_dir(follow_symlinks=False):
                if folder.deep:
                    todo.append(e.path)
            elif e.is_file(follow_symlinks=False):
                row = _file_row(e)
                if row[1] > 0 and row[2] > folder.after and (folder.until is None or row[2] <= folder.until):
                    yield row


def _folders(root: str, after: int = -1, until: int | None = None) -> list[Folder]:
    """The root's own files, and each folder in it."""
    with os.scandir(root) as found:
        below = sorted(e.path for e in found if e.is_dir(follow_symlinks=False))
    return [Folder(root, False, after, until), *(Folder(p, True, after, until) for p in below)]


class MediaReader(DataSourceReader):
    def __init__(self, root: str, wanted: Sequence[str]):
        self.root, self.wanted, self.filters = root, frozenset(wanted), []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Comparisons of a column with values are decided in the walk; all others go back to Spark."""
        for f in filters:
            if type(f) in _TESTS and len(f.attribute) == 1 and f.attribute[0] in _COLUMNS and f.value is not None:
                self.filters.append((_COLUMNS.index(f.attribute[0]), type(f).__name__, f.value))
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        return _folders(self.root)

    def read(self, partition: Folder) -> Iterator[tuple]:
        tests = [(i, _TESTS[{t.__name__: t for t in _TESTS}[name]], value) for i, name, value in self.filters]
        for row in walk(partition):
            if (not self.wanted or row[3] in self.wanted) and all(test(row[i], value) for i, test, value in tests):
                yield row


class MediaStream(DataSourceStreamReader):
    """New files by time of change: an offset is the latest time seen, and a batch holds what lies between two.

    Files must come with a time later than those read before, as copied and
    recorded ones do when they are closed.
    """

    def __init__(self, root: str, wanted: Sequence[str]):
        self.root, self.wanted = root, frozenset(wanted)

    def initialOffset(self) -> dict:
        return {"modified_ns": -1}

    def latestOffset(self) -> dict:
        return {"modified_ns": max((row[2] for folder in _folders(self.root) for row in walk(folder)), default=-1)}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return _folders(self.root, start["modified_ns"], end["modified_ns"])

    def read(self, partition: Folder) -> Iterator[tuple]:
        return (row for row in walk(partition) if not self.wanted or row[3] in self.wanted)


class MediaFiles(DataSource):
    """Options: path, and extensions (with commas; all if not given)."""

    @classmethod
    def name(cls) -> str:
        return "media_files"

    def schema(self) -> str:
        return FILES

    def _asked(self) -> tuple[str, list[str]]:
        path = self.options.get("path")
        if not path:
            raise ValueError("media_files needs a path")
        return path.removeprefix("file://"), [e.strip().lower() for e in self.options.get("extensions", "").split(",") if e.strip()]

    def reader(self, schema: StructType) -> MediaReader:
        return MediaReader(*self._asked())

    def streamReader(self, schema: StructType) -> MediaStream:
        return MediaStream(*self._asked())


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # written aside, name


def file_name(list_id: object) -> str:
    """A list's file: letters, digits, dots, hyphens and underscores of its id, others as percent codes."""
    return re.sub(r"[^A-Za-z0-9._-]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), str(list_id)) + ".edl"


class EditListWriter(DataSourceWriter):
    """Rows (list, line_no, line): a list's rows must be in one partition, in order (see write_edit_lists())."""

    def __init__(self, root: str, overwrite: bool):
        self.root, self.overwrite, self.aside = root, overwrite, f".edit-lists-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Written:
        """Each attempt of a task writes under names of its own, so a repeated or doubled attempt harms none."""
        place = os.path.join(self.root, self.aside)
        os.makedirs(place, exist_ok=True)
        made: dict[str, str] = {}
        now, out = None, None
        try:
            for row in iterator:
                name = file_name(row[0])
                if name != now:
                    if out is not None:
                        out.close()
                    if name in made:
                        raise ValueError(f"the rows of list {row[0]!r} are not together")
                    now, made[name] = name, os.path.join(place, f"{uuid.uuid4().hex}.tmp")
                    out = open(made[name], "w", encoding="utf-8", newline="")
                out.write(f"{row[2]}\r\n")
        finally:
            if out is not None:
                out.close()
        return Written([(aside, name) for name, aside in made.items()])

    def _clear(self) -> None:
        place = os.path.join(self.root, self.aside)
        if os.path.isdir(place):
            for name in os.listdir(place):
                os.remove(os.path.join(place, name))
            os.rmdir(place)

    def commit(self, messages: list[Written | None]) -> None:
        files = [f for m in messages if m is not None for f in m.files]
        names = [name for _, name in files]
        try:
            if len(set(names)) < len(names):
                raise ValueError("a list is spread over partitions")
            there = [n for n in names if os.path.exists(os.path.join(self.root, n))]
            if there and not self.overwrite:
                raise FileExistsError(f"{there[0]} is there already")
            for aside, name in files:
                os.replace(aside, os.path.join(self.root, name))
        finally:
            self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()


class EditLists(DataSource):
    """Option: path, an existing or new folder."""

    @classmethod
    def name(cls) -> str:
        return "edit_lists"

    def schema(self) -> str:
        return "list string, line_no int, line string"

    def writer(self, schema: StructType, overwrite: bool) -> EditListWriter:
        path = self.options.get("path")
        if not path:
            raise ValueError("edit_lists needs a path")
        return EditListWriter(path.removeprefix("file://"), overwrite)


def register(spark: SparkSession) -> None:
    """Make both sources known to a session, with filters pushed down to the listing."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (MediaFiles, EditLists):
        spark.dataSource.register(source)


def write_edit_lists(lines, list_id: str, path: str, *, overwrite: bool = False) -> None:
    """Write the lines of edit lists (list_id, line_no, line: see sources.edl) as one file a list, all or none."""
    from pyspark.sql import functions as F

    register(lines.sparkSession)
    rows = lines.select(F.col(list_id).cast("string").alias("list"), F.col("line_no").cast("int").alias("line_no"), "line")
    together = rows.repartition("list").sortWithinPartitions("list", "line_no")
    together.write.format("edit_lists").mode("overwrite" if overwrite else "append").option("path", path).save()
