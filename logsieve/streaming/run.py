"""Running bounded streams, and rows that wait for the watermark."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessorHandle

from ..workers import shared_folder

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_EPOCH = dt.datetime(1970, 1, 1)


def milliseconds(times: pd.Series) -> list[int]:
    """UTC milliseconds of a timestamp column."""
    if times.dt.tz is not None:
        times = times.dt.tz_convert("UTC").dt.tz_localize(None)
    return (times.astype("datetime64[us]").astype("int64") // 1000).tolist()


def moment(ms: int) -> dt.datetime:
    return _EPOCH + dt.timedelta(milliseconds=ms)


class HeldRows:
    """Rows of a key that wait until the watermark has passed their time: one for each time and name.

    A row that comes again replaces the first. One timer is set, for the earliest time.
    """

    def __init__(self, handle: StatefulProcessorHandle, names: str, values: str):
        self.handle = handle
        self.rows = handle.getMapState("held", f"time bigint, {names}", values)
        self.due = handle.getValueState("due", "time bigint")

    def add(self, rows: Iterable[tuple[int, tuple, tuple]]) -> None:
        """(time, name, value) of each row, later than the watermark."""
        first = None
        for time, name, value in rows:
            self.rows.updateValue((time, *name), value)
            first = time if first is None else min(first, time)
        if first is not None and (not self.due.exists() or first < self.due.get()[0]):
            self._wait(first)

    def _wait(self, time: int) -> None:
        self.due.update((time,))
        self.handle.registerTimer(time)

    def take(self, now: int) -> list[tuple[int, list[tuple[tuple, tuple]]]]:
        """Removes and returns what is due: (time, [(name, value)]) in the order of time."""
        if not self.due.exists() or self.due.get()[0] > now:
            return []
        found: dict[int, list] = {}
        later = None
        for (time, *name), value in list(self.rows.iterator()):
            if time <= now:
                found.setdefault(time, []).append((tuple(name), tuple(value)))
            else:
                later = time if later is None else min(later, time)
        for time, rows in found.items():
            for name, _ in rows:
                self.rows.removeKey((time, *name))
        self.due.clear()
        if later is not None:
            self._wait(later)
        return sorted(found.items())


@contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[str]:
    """A new folder that driver and executors share; removed in the end."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def late_rows(progress: Iterable) -> int:
    """Rows that came behind the watermark and were dropped, by the progress reports of a query."""
    return sum(op.numRowsDroppedByWatermark for p in progress for op in p.stateOperators)


def drain(stream: DataFrame, folder: str, progress: list | None = None) -> DataFrame:
    """Runs a bounded stream to its end into a Parquet table under ``folder`` and returns that table.

    ``folder`` also keeps the stream's checkpoint, so that a run can be taken up again, after a failure or when more has
    come; it must be shared by driver and executors. ``progress`` gets the reports of the triggers.
    """
    conf = stream.sparkSession.conf
    before = conf.get(PROVIDER, None)
    conf.set(PROVIDER, ROCKS_DB)  # what keeps timers and typed state
    try:
        writer = stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
        query = writer.option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/rows").start()
    finally:
        conf.set(PROVIDER, before) if before else conf.unset(PROVIDER)
    query.awaitTermination()
    if progress is not None:
        progress.extend(query.recentProgress)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")
