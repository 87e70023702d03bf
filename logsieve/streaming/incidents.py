"""Streams of anomalies to anomaly events, and of anomalies to incidents."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..config import IncidentConfig
from ..functions import scoring
from ..operators.detect import event_entry, stable_id, time_text
from ..operators.incidents import family_bit, finish_incidents
from ..schemas import SEVERITIES
from ..workers import importable
from .run import HeldRows, milliseconds, moment


def _timed(anomalies: DataFrame, delay: str) -> DataFrame:
    return anomalies.withColumn("window_start", F.col("window_start").cast("timestamp")).withWatermark("window_start", delay)


def stream_events(anomalies: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Anomaly events of a stream of ``stream_anomalies`` rows, out once the watermark has passed their window.

    ``window_start`` is a timestamp here, since watermarks need one. Rows later than ``delay`` behind the newest are dropped.
    Suppressed rows make no event but move the watermark: they are left out inside the aggregation, since a filter on them would
    be pushed below the watermark.
    """
    rows = _timed(anomalies, delay).withColumn("baseline", F.struct(F.col("baseline_mean").alias("mean"), F.col("baseline_std").alias("std")))
    active = ~F.col("suppressed")
    events = rows.groupBy("service", "window_start").agg(
        F.max(F.when(active, F.col("score"))).alias("score"),
        F.max(F.when(active, F.col("severity_rank"))).alias("severity_rank"),
        F.array_sort(F.collect_list(F.when(active, event_entry()))).alias("anomalies"),
    )
    return events.where(F.size("anomalies") > 0).withColumns(
        {
            "event_id": stable_id(F.col("service"), time_text(F.col("window_start"))),
            "severity": scoring.severity_name(F.col("severity_rank")),
        }
    )


_COUNTS = [f"n_{name}" for name in SEVERITIES[1:]]
_INCIDENT = (
    "service string, start_time timestamp_ntz, end_time timestamp_ntz, anomaly_count bigint, feature_count bigint, max_score double, "
    "severity_rank int, " + ", ".join(f"{n} bigint" for n in _COUNTS)
)
_MEMBER = "service string, window_start timestamp_ntz, start_time timestamp_ntz"


class _Sessions(StatefulProcessor):
    """State of one service: anomalies that wait for the watermark, and the open incident's families and running metrics."""

    def __init__(self, config: IncidentConfig, members: bool):
        self.config, self.members = config, members

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = HeldRows(handle, "ordinal int", "family int, score double, rank int")
        self.open = handle.getValueState(
            "open", "start bigint, last bigint, families int, features bigint, events bigint, score double, rank int, counts array<bigint>"
        )

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            part = part[~part["suppressed"].astype(bool)]
            columns = (part[c].tolist() for c in ("ordinal", "family", "score", "severity_rank"))
            self.held.add(
                (t, (int(ordinal),), (int(bit), float(score), int(rank)))
                for t, ordinal, bit, score, rank in zip(milliseconds(part["window_start"]), *columns, strict=True)
            )
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, gap, out = timerValues.getCurrentWatermarkInMs(), 1000 * self.config.max_gap_seconds, []
        before = state = self.open.get() if self.open.exists() else None
        for time, rows in self.held.take(now):
            families = features = 0
            counts = [0] * len(_COUNTS)
            for (ordinal,), (bit, _, rank) in rows:
                families, features = families | bit, features | 1 << ordinal
                if rank:
                    counts[rank - 1] += 1
            score, rank = max(v[1] for _, v in rows), max(v[2] for _, v in rows)
            joins = state is not None and time - state[1] <= gap and (not self.config.require_feature_family_overlap or state[2] & families)
            if joins:
                start, _, f, b, n, s, r, c = state
                state = (start, time, f | families, b | features, n + 1, max(s, score), max(r, rank), [x + y for x, y in zip(c, counts, strict=True)])
            else:
                if state is not None:
                    out.append(self._closed(key[0], state))
                state = (time, time, families, features, 1, score, rank, counts)
            if self.members:
                out.append({"service": key[0], "window_start": moment(time), "start_time": moment(state[0])})
        if state is not None and state[1] + gap < now:  # nothing that could join can come any more
            out.append(self._closed(key[0], state))
            self.open.clear()
        elif state is not None and state != before:
            self.open.update(state)
            self.handle.registerTimer(state[1] + gap + 1)
        out = [row for row in out if row is not None]
        if out:
            yield pd.DataFrame(out)

    def _closed(self, service: str, state: tuple) -> dict | None:
        if self.members:
            return None
        start, last, _, features, events, score, rank, counts = state
        row = {"service": service, "start_time": moment(start), "end_time": moment(last + 1000 * self.config.window_size_seconds), "anomaly_count": events}
        return row | {"feature_count": features.bit_count(), "max_score": score, "severity_rank": rank} | dict(zip(_COUNTS, counts, strict=True))

    def close(self) -> None:
        pass


def _sessions(anomalies: DataFrame, config: IncidentConfig, delay: str, members: bool) -> DataFrame:
    if config.merge_across_services:
        raise ValueError("streamed incidents never cross services")
    importable(anomalies.sparkSession)
    rows = _timed(anomalies, delay).withColumn("family", family_bit(F.col("feature")))
    rows = rows.select("service", "window_start", "ordinal", "family", "score", "severity_rank", "suppressed").groupBy("service")
    return rows.transformWithStateInPandas(_Sessions(config, members), _MEMBER if members else _INCIDENT, "append", "EventTime")


def stream_incidents(anomalies: DataFrame, config: IncidentConfig = IncidentConfig(), delay: str = "1 hour") -> DataFrame:
    """Closed incidents of a stream of ``stream_anomalies`` rows: those of ``incident_metrics``, without the list of their events.

    Anomalies wait for the watermark, so their order of arrival within ``delay`` doesn't matter; then each event joins the open
    incident of its service or begins another. Of an open incident the state is its bounds, families and running
    metrics, whatever its length. A timer closes it once nothing that could join can come. Suppressed anomalies
    move the watermark and do nothing else. Incidents that cross services need the batch plan.
    """
    return finish_incidents(_sessions(anomalies, config, delay, members=False))


def stream_members(anomalies: DataFrame, config: IncidentConfig = IncidentConfig(), delay: str = "1 hour") -> DataFrame:
    """event_id, service, window_start and incident_id of every event, out as soon as the watermark has passed it."""
    rows = _sessions(anomalies, config, delay, members=True)
    return rows.select(
        stable_id(F.col("service"), time_text(F.col("window_start"))).alias("event_id"), "service", "window_start",
        stable_id(F.col("service"), time_text(F.col("start_time"))).alias("incident_id"),
    )
