"""Log sources of one's own: a format by its name, read in partitions, in batch and as a stream.

A source says which ranges of a file are read on their own, and which rows a range has::

    class MySource(LogSource):
        format = "mine"

        def rows(self, part):
            for line_offset, line in part.lines():
                yield {"timestamp": ..., "message": ...}

    register_source(spark, MySource)
    read_logs(spark, path, "mine")                      # batch
    spark.readStream.format("mine").load(path)          # grows with its files

The engine plans with Spark's Python Data Source API: a partition for each range of a file. Rows are those of the other readers:
``fields`` and ``source_meta``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..schemas import RAW_FIELDS
from ..workers import importable


#: Bytes that are read at first beyond the end of a range, for the rest of its last line.
BEYOND = 1 << 12
#: A batch read has about this many partitions, or more, if they would hold more than ``PACK_BYTES`` each. A range is never cut.
PACKS, PACK_BYTES = 256, 16 << 20


@dataclass
class FileRange(InputPartition):
    """The rows of a file that begin in some of its bytes."""

    path: str
    first: int
    last: int
    length: int

    def open(self):
        system, inner = _system(self.path)
        return system.open_input_file(inner)

    def lines(self, chunk: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
        """(offset, line) of the lines that begin in the range; the last one is read to its end. A byte is copied once or twice."""
        with self.open() as file:
            at = self.first
            if at:  # a line that began before belongs to the range before
                file.seek(at - 1)
                at += len(_to_end(file, min(chunk, BEYOND))) - 1
            file.seek(at)
            held, read = [], at  # parts of a line whose end hasn't been read, and the place up to which has been
            while at < self.last:
                data = file.read(min(chunk, self.last - read if read < self.last else max(BEYOND, read - at)))
                read += len(data)
                *ended, rest = data.split(b"\n")
                for line in ended:
                    line = b"".join([*held, line])
                    yield at, line
                    held, at = [], at + len(line) + 1
                    if at >= self.last:
                        return
                held.append(rest)
                if not data:
                    if line := b"".join(held):
                        yield at, line
                    return


def _to_end(file, chunk: int) -> bytes:
    """From where the file stands to the next end of line, that included."""
    parts = []
    while data := file.read(chunk):
        chunk = min(2 * chunk, 1 << 20)
        line, mark, _ = data.partition(b"\n")
        parts.append(line + mark)
        if mark:
            break
    return b"".join(parts)


def _system(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def list_lengths(path: str) -> dict[str, int]:
    """Length of the file, or of each file below the folder, that ``path`` names; hidden files are left out."""
    system, inner = _system(path)
    scheme = path[: path.index(inner)] if inner in path else ""
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(f"log source not found: {path}")
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner, recursive=True))
    shown = (f for f in found if f.type == fs.FileType.File and not re.search(r"(^|/)[._][^/]*$", f.path))
    return {scheme + f.path: f.size for f in sorted(shown, key=lambda f: f.path)}


class LogSource(DataSource):
    """A source of logs in files. Subclasses name their ``format`` and turn a range of a file into rows."""

    format = ""
    range_bytes = 16 << 20

    @classmethod
    def name(cls) -> str:
        if not cls.format:
            raise ValueError(f"{cls.__name__} names no format")
        return cls.format

    def schema(self) -> str:
        return RAW_FIELDS

    def rows(self, part: FileRange) -> Iterator[Mapping[str, str | None] | tuple[Mapping[str, str | None], int | None]]:
        """The fields of each log of a range, alone or with the log's index in its file."""
        raise NotImplementedError

    def ranges(self, path: str, first: int, last: int, length: int) -> list[FileRange]:
        """How bytes ``first`` to ``last`` of a file are read: override for formats that can't be entered everywhere."""
        size = int(self.options.get("rangeBytes", self.range_bytes))
        return [FileRange(path, a, min(a + size, last), length) for a in range(first, last, size)]

    def reader(self, schema) -> DataSourceReader:
        return _BatchReader(self)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self)

    @property
    def path(self) -> str:
        path = self.options.get("path")
        if not path:
            raise ValueError(f"format {self.format} needs a path")
        return path

    def _records(self, part: FileRange) -> Iterator[tuple]:
        for row in self.rows(part):
            fields, index = row if isinstance(row, tuple) else (row, None)
            yield dict(fields), (part.path, None, index, self.format)


@dataclass
class _Pack(InputPartition):
    """Ranges that one task reads, one after another."""

    ranges: list[FileRange]


def pack(ranges: list[FileRange], packs: int = PACKS, most: int = PACK_BYTES) -> list[list[FileRange]]:
    """Neighbouring ranges together, all of them: a task for each would cost more than to read it, if they are small and many."""
    size = min(most, sum(r.last - r.first for r in ranges) // packs)
    found, room = [], 0
    for r in ranges:
        if not found or r.last - r.first > room:
            found.append([])
            room = size
        found[-1].append(r)
        room -= r.last - r.first
    return found


class _BatchReader(DataSourceReader):
    def __init__(self, source: LogSource):
        self.source = source

    def partitions(self) -> list[_Pack]:
        files = list_lengths(self.source.path)
        ranges = [r for path, n in files.items() for r in self.source.ranges(path, 0, n, n)]
        return [_Pack(p) for p in pack(ranges)] or [_Pack([])]

    def read(self, partition: _Pack) -> Iterator[tuple]:
        for part in partition.ranges:
            yield from self.source._records(part)


class _StreamReader(DataSourceStreamReader):
    """The offset is the length of each file that has been read; a file's growth is read from there."""

    def __init__(self, source: LogSource):
        self.source = source

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return list_lengths(self.source.path)

    def partitions(self, start: dict, end: dict) -> list[FileRange]:
        grown = ((path, start.get(path, 0), n) for path, n in end.items() if n > start.get(path, 0))
        return [r for path, first, n in grown for r in self.source.ranges(path, first, n, n)]

    def read(self, partition: FileRange) -> Iterator[tuple]:
        return self.source._records(partition)

    def commit(self, end: dict) -> None:
        pass


class LogfmtSource(LogSource):
    """Lines of ``key=value`` pairs; values with blanks stand in double quotes, with backslash escapes. Blank lines are no logs.

    Half a line at the end of a file is read as a line; as a stream the file should grow by whole lines.
    """

    format = "logfmt"
    _PAIR = re.compile(r'([^\s="]+)(?:=(?:"((?:[^"\\]|\\.)*)"|([^\s"]*)))?')
    _ESCAPE = re.compile(r"\\(.)", re.S)

    def rows(self, part: FileRange) -> Iterator[dict[str, str | None]]:
        for at, line in part.lines():
            text = line.decode("utf-8", "replace")
            if at == 0:
                text = text.removeprefix("﻿")
            if text.strip():
                yield self.fields(text)

    @classmethod
    def fields(cls, text: str) -> dict[str, str | None]:
        found = {}
        for key, quoted, bare in cls._PAIR.findall(text):
            found[key] = cls._ESCAPE.sub(lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), quoted) if quoted else bare
        return found


#: Formats of sources that have been registered, by name.
FORMATS: dict[str, type[LogSource]] = {}


def register_source(spark: SparkSession, source: type[LogSource]) -> None:
    """Makes a source known to ``spark.read.format`` and to ``read_logs``."""
    importable(spark)
    spark.dataSource.register(source)
    FORMATS[source.name()] = source
