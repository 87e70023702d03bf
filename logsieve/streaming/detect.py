"""Streams of logs to windows of features, and of features to anomalies."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..config import DetectionConfig
from ..operators.detect import family
from ..operators.features import at_share, features_long
from ..schemas import FEATURES
from ..workers import importable
from .run import HeldRows, milliseconds, moment
from .state import ServiceState

ANOMALY = (
    "service string, window_start timestamp_ntz, feature string, ordinal int, observed double, baseline_mean double, "
    "baseline_std double, z_score double, rate_change double, score double, severity_rank int, direction string, "
    "suppressed boolean"
)
_NAMES = [c.split(" ")[0] for c in ANOMALY.split(", ")]


def stream_features(logs: DataFrame, seconds: int = 300, delay: str = "10 minutes") -> DataFrame:
    """Features of closed windows. Logs later than ``delay`` behind the newest one are dropped.

    Two aggregations, as in batch: values are counted by window first (levels with durations, messages, error codes), so that
    a state row is one value and its count and a hot window spreads over its values; their counts make the window's features
    when the watermark has closed it.
    """
    rows = logs.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", delay)
    text = lambda c: F.nullif(F.col(c), F.lit(""))
    none, no_number = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    value = lambda kind, level, number, name: F.struct(
        F.lit(kind).alias("kind"), level.alias("level"), number.alias("duration_ms"), name.alias("name")
    )
    values = F.array(
        value("log", F.col("level"), F.col("duration_ms"), none),
        value("message", none, no_number, text("message_hash")),
        value("code", none, no_number, text("error_code")),
    )
    rows = rows.select("timestamp", "service", F.inline(values)).where("kind = 'log' OR name IS NOT NULL")
    size = f"{seconds} seconds"
    counted = rows.groupBy("service", F.window("timestamp", size).alias("w"), "kind", "level", "duration_ms", "name")
    counted = counted.agg(F.count(F.lit(1)).alias("n")).withColumn("closed", F.window_time("w"))
    of = lambda *levels: F.coalesce(F.sum(F.when(F.col("level").isin(*levels), F.col("n"))), F.lit(0).cast("bigint"))
    timed = F.when(F.col("duration_ms").isNotNull(), F.struct("duration_ms", "n"))
    wide = counted.groupBy("service", F.window("closed", size).alias("w")).agg(
        F.sum(F.when(F.col("kind") == "log", F.col("n"))).alias("total_events"),
        of("ERROR", "CRITICAL").alias("error_count"),
        of("WARNING").alias("warning_count"),
        of("INFO").alias("info_count"),
        F.percentile("duration_ms", 0.5, F.col("n")).alias("median_duration_ms"),
        F.array_sort(F.collect_list(timed)).alias("timed"),
        F.max("duration_ms").cast("double").alias("max_duration_ms"),
        F.count_if(F.col("kind") == "message").alias("unique_messages"),
        F.count_if(F.col("kind") == "code").alias("unique_error_codes"),
    )
    own = {
        "error_rate": F.col("error_count") / F.col("total_events"),
        "warning_rate": F.col("warning_count") / F.col("total_events"),
        "p95_duration_ms": at_share(F.col("timed"), 0.95).cast("double"),
    }
    return wide.select("service", *(own.get(f, F.col(f)).alias(f) for f in FEATURES), F.col("w.start").cast("timestamp_ntz").alias("window_start"))


class _Detector(StatefulProcessor):
    """State of one service and feature family: windows that wait for the watermark, and the history of each feature."""

    def __init__(self, config: DetectionConfig, idle_ms: int | None):
        self.config, self.idle = config, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = HeldRows(handle, "feature string", "observed double")
        self.history = handle.getMapState("history", "feature string", "past array<double>, count bigint, mean double, var double, last double")
        self.newest = handle.getValueState("newest", "start bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        newest = before = self.newest.get()[0] if self.newest.exists() else None
        for part in rows:
            starts = milliseconds(part["window_start"])
            self.held.add((start, (feature,), (observed,)) for start, feature, observed in zip(starts, part["feature"], part["observed"], strict=True))
            newest = max(starts) if newest is None else max(newest, *starts)
        if newest != before:
            self.newest.update((newest,))
            if self.idle is not None:
                if before is not None:
                    self.handle.deleteTimer(before + self.idle + 1)
                self.handle.registerTimer(newest + self.idle + 1)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, found = timerValues.getCurrentWatermarkInMs(), []
        due = self.held.take(now)
        if due:
            state = ServiceState.of({k[0]: (list(v[0]), *v[1:]) for k, v in self.history.iterator()}, self.config)
            for start, values in due:
                found += [{"service": key[0], "window_start": moment(start), **a} for a in state.update({f: x for (f,), (x,) in values})]
            for feature, row in state.rows().items():
                self.history.updateValue((feature,), row)
        if self.idle is not None and self.newest.exists() and self.newest.get()[0] + self.idle < now:
            self.history.clear()
            self.newest.clear()
        if found:
            yield pd.DataFrame(found, columns=_NAMES)

    def close(self) -> None:
        pass


def stream_anomalies(
    features: DataFrame, config: DetectionConfig = DetectionConfig(), delay: str = "1 hour", idle_seconds: int | None = None
) -> DataFrame:
    """Anomalies of a stream of feature vectors, suppressed ones marked, in any order of arrival within ``delay``.

    A window is held until the watermark has passed it and is then scored in its place, so a stream gives
    the rows of batch. Windows later than ``delay`` behind the newest one are dropped and counted (``late_rows``). State is
    kept by service and feature family: suppression never looks further, and a hot service's families are worked on
    by several tasks. With ``idle_seconds`` the history of a family without a window for longer is forgotten.
    A window without features moves the watermark too.
    """
    importable(features.sparkSession)
    rows = features.withColumn("window_start", F.col("window_start").cast("timestamp")).withWatermark("window_start", delay)
    rows = features_long(rows).withColumn("family", family(F.col("feature")))
    grouped = rows.select("service", "family", "window_start", "feature", "observed").groupBy("service", "family")
    idle = None if idle_seconds is None else 1000 * idle_seconds
    return grouped.transformWithStateInPandas(_Detector(config, idle), ANOMALY, "append", "EventTime")
