"""JSON array files of any size, read by byte ranges.

Whether a comma parts two items depends on all before it: it must stand outside of strings, inside the outermost
array only. Each range of a file is scanned once for every state that it may begin in (outside of a string, inside one, inside one
after a backslash), which gives the state that it ends in, the change of depth, and the commas by relative depth.
Such summaries compose: within groups of ``GROUP`` ranges, then over a file's groups, so that every
range learns its own state, depth and first item. Tasks then read their ranges again and give the items that begin in
them, the last one beyond the range's end if need be. A task holds one range and one item.

Files are listed by Spark (names and lengths) and read through the file systems that Arrow knows by the path's scheme.
"""

from __future__ import annotations

import json
import math
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain, groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workers import importable

#: Schemes that tasks can open.
SCHEMES = ("file", "hdfs", "s3", "s3a", "gs")
RANGE_BYTES = 16 << 20
GROUP = 1024
#: Bytes of the files to a task, if that gives every core one.
TASK_BYTES = 16 << 20
OUTSIDE, INSIDE, ESCAPED = 0, 1, 2
_BLANK = b" \t\r\n"
_BOM = b"\xef\xbb\xbf"
_STEP = np.zeros(256, np.int64)
_STEP[[ord("["), ord("{")]] = 1
_STEP[[ord("]"), ord("}")]] = -1
_MARK = np.zeros(256, bool)
_MARK[list(b"[]{},")] = True
_COMMA = ord(",")


class InvalidArray(ValueError):
    """A file that begins like an array isn't one."""

    def __init__(self, name: str, what: str):
        super().__init__(f"invalid JSON array: {what} in {name}")


def open_file(name: str):
    """A file by the name that Spark gives it; ``file:/a`` means a local one."""
    if name.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + name.removeprefix("file:").lstrip("/"))
    system, inner = fs.FileSystem.from_uri(name.replace("s3a://", "s3://", 1))
    return system.open_input_file(inner)


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """name (as Spark's readers give it), path, length and whether tasks can open the file by ranges."""
    files = spark.read.format("binaryFile").load(path)
    rows = files.select(F.col("_metadata.file_path").alias("name"), "path", "length")
    packed = F.lower("path").rlike(r"\.(gz|bz2|deflate|lz4|snappy|zst|xz)$")
    return rows.withColumn("ranged", F.regexp_extract("path", "^([a-z0-9]+):", 1).isin(*SCHEMES) & ~packed)


# --- structure ------------------------------------------------------------------------------------------------------


def structure(data: bytes, state: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(places of brackets and commas outside of strings, relative depth after each, state at the end)."""
    chars = np.frombuffer(data, np.uint8)
    if state == ESCAPED and len(chars):
        places, depth, end = structure(data[1:], INSIDE)
        return places + 1, depth, end
    slash = chars == ord("\\")
    quotes = chars == ord('"')
    escaped = False
    if slash.any():
        edge = np.diff(np.concatenate(([0], slash.view(np.int8), [0])))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        after = ends[(ends - starts) % 2 == 1]
        escaped = bool(len(after)) and after[-1] == len(chars)
        quotes[after[after < len(chars)]] = False
    turns = np.cumsum(quotes)
    places = np.flatnonzero(_MARK[chars])
    places = places[(turns[places] + state) % 2 == 0]
    within = (state + (int(turns[-1]) if len(turns) else 0)) % 2
    end = ESCAPED if escaped and within else within
    return places, np.cumsum(_STEP[chars[places]]), end


def summary(data: bytes) -> list[tuple[int, int, int, dict[int, int]]]:
    """For every state that ``data`` may begin in: end state, change of depth, marks, and commas by relative depth."""
    chars, found = np.frombuffer(data, np.uint8), []
    for state in (OUTSIDE, INSIDE, ESCAPED):
        if state == ESCAPED and len(data) and data[0] not in b'"\\':
            found.append(found[INSIDE])  # the first byte means nothing either way
            continue
        places, depth, end = structure(data, state)
        values, counts = np.unique(depth[chars[places] == _COMMA], return_counts=True)
        found.append((end, int(depth[-1]) if len(depth) else 0, len(places), dict(zip(values.tolist(), counts.tolist(), strict=True))))
    return found


def compose(first: list, second: list) -> list:
    """The summary of two neighbouring ranges."""
    out = []
    for end, change, marks, commas in first:
        last, more, others, later = second[end]
        both = Counter(commas)
        for depth, n in later.items():
            both[depth + change] += n
        out.append((last, change + more, marks + others, dict(both)))
    return out


def _text_of(found: list) -> str:
    return json.dumps([[*row[:3], list(row[3].items())] for row in found])


def _summary_of(text: str) -> list:
    return [(end, change, marks, dict(commas)) for end, change, marks, commas in json.loads(text)]


def _begins(rows: Iterable[dict], state: int, depth: int, marks: int, item: int) -> Iterator[tuple[dict, int, int, int, int]]:
    """Each of some neighbouring ranges with (state, depth, marks before, item) at its beginning."""
    for row in rows:
        yield row, state, depth, marks, item
        end, change, more, commas = _summary_of(row["summary"])[state]
        item += commas.get(1 - depth, 0)
        state, depth, marks = end, depth + change, marks + more


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    return (row for batch in batches for row in batch.to_pylist())


def _batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 10_000) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _tasks(files: DataFrame, range_bytes: int) -> int:
    """How many tasks share the files. Ranges are light rows of heavy work: by their own size Spark would give all of them to one task."""
    size = F.greatest(F.col("length"), F.lit(0))
    total, ranges = files.agg(F.sum(size), F.sum(F.ceil(size / range_bytes))).first()
    cores = files.sparkSession.sparkContext.defaultParallelism
    return max(min(max(2 * cores, math.ceil((total or 0) / TASK_BYTES)), ranges or 0), 1)


def _ranges(files: DataFrame, range_bytes: int) -> DataFrame:
    at = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(range_bytes).cast("bigint"))).alias("at")
    rows = files.where("length > 0").select("name", "path", "length", at)
    return rows.withColumns({"block": F.floor(F.col("at") / range_bytes), "size": F.least(F.lit(range_bytes), F.col("length") - F.col("at"))})


def range_states(files: DataFrame, range_bytes: int = RANGE_BYTES, group: int = GROUP, tasks: int | None = None) -> DataFrame:
    """name, path, length, at, size and (state, depth, marks, item) at the beginning of every range of ``files``."""
    tasks = tasks or _tasks(files, range_bytes)
    ranges = _ranges(files, range_bytes).repartition(tasks, "name", "block")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                with open_file(row["path"]) as file:
                    found.append(_text_of(summary(_read(file, row))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*batch.schema.names, "summary"])

    light = ranges.select("name", "path", "length", "at", "size", "block")
    kinds = ", ".join(f"{c} {t}" for c, t in light.dtypes)
    light = light.mapInArrow(scan, f"{kinds}, summary string").withColumn("part", F.floor(F.col("block") / group))
    text, whole = pa.string(), pa.int64()

    # Each step streams sorted rows: neighbouring ranges of a group, then the groups of a file, then the ranges again.
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def merged():
            for (name, part), rows in groupby(_rows(batches), itemgetter("name", "part")):
                found = None
                for row in rows:
                    own = _summary_of(row["summary"])
                    found = own if found is None else compose(found, own)
                yield name, part, _text_of(found)

        return _batches(merged(), pa.schema([("name", text), ("part", whole), ("summary", text)]))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = groupby(_rows(batches), itemgetter("name"))
        placed = ((row["name"], row["part"], *begun) for _, rows in files for row, *begun in _begins(rows, OUTSIDE, 0, 0, 0))
        names = ("g_state", "g_depth", "g_marks", "g_item")
        return _batches(placed, pa.schema([("name", text), ("part", whole), *((n, whole) for n in names)]))

    def spread_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def begun():
            for _, rows in groupby(_rows(batches), itemgetter("name", "part", "g_state", "g_depth", "g_marks", "g_item")):
                first = next(rows)
                start = [first[c] for c in ("g_state", "g_depth", "g_marks", "g_item")]
                for row, *at in _begins(chain((first,), rows), *start):
                    yield (*(row[c] for c in ("name", "path", "length", "at", "size")), *at)

        ours = [("name", text), ("path", text), *((n, whole) for n in ("length", "at", "size", "state", "depth", "marks", "item"))]
        return _batches(begun(), pa.schema(ours))

    groups = light.select("name", "part", "block", "summary").repartition("name", "part").sortWithinPartitions("name", "part", "block")
    groups = groups.mapInArrow(merge, "name string, part bigint, summary string")
    placed = groups.repartition("name").sortWithinPartitions("name", "part")
    placed = placed.mapInArrow(place, "name string, part bigint, g_state bigint, g_depth bigint, g_marks bigint, g_item bigint")
    states = light.join(placed, ["name", "part"]).repartition("name", "part").sortWithinPartitions("name", "part", "block")
    return states.mapInArrow(
        spread_out, "name string, path string, length bigint, at bigint, size bigint, state bigint, depth bigint, marks bigint, item bigint"
    )


def _read(file, row: dict) -> bytes:
    data = file.read_at(row["size"], row["at"])
    if len(data) != row["size"]:
        raise OSError(f"{row['path']} became shorter while it was read")
    return data


def items_of(file, row: dict, chunk: int = 1 << 16) -> Iterator[tuple[int, bytes]]:
    """(index, text) of the items that begin in a range, given its state; fails if the range breaks the array."""
    name, data = row["name"], _read(file, row)
    places, depth, state = structure(data, row["state"])
    depth = depth + row["depth"]
    index, begin, closed = row["item"], None, row["depth"] == 0 and row["marks"] > 0
    past = 0  # what follows the closed array
    if not row["marks"]:
        ahead = data[: places[0]] if len(places) else data
        if ahead.removeprefix(_BOM if row["at"] == 0 else b"").strip(_BLANK):
            raise InvalidArray(name, "something before the array")
    for place, deep in zip(places.tolist(), depth.tolist(), strict=True):
        if closed:
            break
        char = data[place]
        if deep == 1 and _STEP[char] == 1:  # the array's own bracket
            if char != ord("["):
                raise InvalidArray(name, "an object")
            begin = place + 1
        elif (deep == 1 and char == _COMMA) or deep == 0:
            if char == ord("}"):
                raise InvalidArray(name, "a brace that closes nothing")
            if begin is not None:
                yield from _item(name, index, data[begin:place], last=deep == 0)
            if deep == 0:
                closed, past, begin = True, place + 1, None
            else:
                index, begin = index + 1, place + 1
        elif deep < 0:
            raise InvalidArray(name, "a bracket that closes nothing")
    if closed and data[past:].strip(_BLANK):
        raise InvalidArray(name, "something after the array")
    at_end = row["at"] + row["size"]
    if begin is None:
        if at_end == row["length"] and not closed:
            raise InvalidArray(name, "no end")
        return
    # The last item goes on in later ranges.
    text, deep, more = [data[begin:]], int(depth[-1]), at_end
    while more < row["length"]:
        data = file.read_at(chunk, more)
        places, steps, after = structure(data, state)
        for place, level in zip(places.tolist(), (steps + deep).tolist(), strict=True):
            if level == 0 or (level == 1 and data[place] == _COMMA):
                if data[place] == ord("}"):
                    raise InvalidArray(name, "a brace that closes nothing")
                yield from _item(name, index, b"".join(text) + data[:place], last=level == 0)
                return
        text.append(data)
        state, more = after, more + len(data)
        deep += int(steps[-1]) if len(steps) else 0
    raise InvalidArray(name, "no end")


def _item(name: str, index: int, text: bytes, last: bool) -> Iterator[tuple[int, bytes]]:
    text = text.strip(_BLANK)
    if text:
        yield index, text
    elif index or not last:
        raise InvalidArray(name, "an empty item")


def read_items(files: DataFrame, range_bytes: int = RANGE_BYTES, group: int = GROUP) -> DataFrame:
    """name, idx (from 0) and value of every item of the array files ``files`` (name, path, length)."""
    importable(files.sparkSession)
    tasks = _tasks(files, range_bytes)
    states = range_states(files, range_bytes, group, tasks).repartition(tasks, "name", "at")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with open_file(row["path"]) as file:
                    found = list(items_of(file, row))
                for i in range(0, len(found), 10_000):
                    part = found[i : i + 10_000]
                    values = pa.array([x[1] for x in part], pa.binary()).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array([row["name"]] * len(part)), pa.array([x[0] for x in part], pa.int64()), values], names=["name", "idx", "value"])

    return states.mapInArrow(work, "name string, idx bigint, value string")


def array_flags(files: DataFrame, chunk: int = 1 << 12) -> DataFrame:
    """name, path, length and is_array: whether the first byte that isn't blank is a bracket. Reads no more than that."""
    importable(files.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flags = []
            for row in batch.to_pylist():
                head, at = b"", 0
                with open_file(row["path"]) as file:
                    while at < row["length"] and not head:
                        data = file.read_at(chunk, at)
                        head = (data.removeprefix(_BOM) if at == 0 else data).lstrip(_BLANK + b"\x0b\x0c")
                        at += chunk
                flags.append(head[:1] == b"[")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(flags, pa.bool_())], names=[*batch.schema.names, "is_array"])

    rows = files.select("name", "path", "length")
    return rows.mapInArrow(work, "name string, path string, length bigint, is_array boolean")
