"""Streams that come out of order, over several triggers and restarts, against batch."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from logsieve.config import BaselineConfig, DetectionConfig, IncidentConfig
from logsieve.operators import detect, features, incidents
from logsieve.schemas import CANONICAL, FEATURE_VECTOR, FEATURES
from logsieve.streaming.detect import stream_anomalies, stream_features
from logsieve.streaming.incidents import stream_events, stream_incidents, stream_members
from logsieve.streaming.run import drain, late_rows, scratch
from logsieve.workers import kept

from .test_windows_detect import at, make_logs, make_vectors, random_vectors, vector


def feed(rows, path, **own):
    """One file: one trigger."""
    rows.withColumns({k: F.lit(v) for k, v in own.items()}).coalesce(1).write.mode("append").parquet(path)


def beat(spark, schema, path, seconds, column="window_start", **own):
    """A row of no use that moves the watermark."""
    one = spark.createDataFrame([(at(seconds),)], "t timestamp_ntz")
    kinds = spark.createDataFrame([], schema).dtypes
    values = {"service": F.lit("beat"), column: F.col("t")} | {k: F.lit(v) for k, v in own.items()}
    one.select(*(values.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in kinds)).coalesce(1).write.mode("append").parquet(path)


def source(spark, schema, path):
    os.makedirs(path, exist_ok=True)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def anomalies_key(df):
    return sorted((r.service, r.window_start, r.feature, r.suppressed, round(r.score, 9)) for r in df.collect())


@pytest.mark.parametrize("strategy", ["hybrid", "rolling", "ewma"])
def test_shuffled_windows_give_batch_rows(spark, tmp_path, strategy):
    """Five triggers with windows of the whole range each, a restart after each of them."""
    config = DetectionConfig(baseline=BaselineConfig(strategy=strategy))
    rows = random_vectors(n=50)
    random.Random(8).shuffle(rows)
    stream = stream_anomalies(source(spark, FEATURE_VECTOR, str(tmp_path / "in")), config, "1 day")
    for i in range(5 if strategy == "hybrid" else 2):
        step = 5 if strategy == "hybrid" else 2
        feed(make_vectors(spark, rows[i::step]), str(tmp_path / "in"))
        assert drain(stream, str(tmp_path / "out")).count() == 0  # all windows wait
    beat(spark, FEATURE_VECTOR, str(tmp_path / "in"), 10 * 86400)
    got = drain(stream, str(tmp_path / "out"))
    want = detect.suppress(detect.feature_anomalies(make_vectors(spark, rows), config))
    assert anomalies_key(got) == anomalies_key(want) and got.count() > 20


def test_windows_leave_when_the_watermark_passes_them(spark, tmp_path):
    """History lives between triggers: what is out stays out, what comes late is counted and changes nothing."""
    rows = random_vectors(n=60)
    path, progress = str(tmp_path / "in"), []
    stream = stream_anomalies(source(spark, FEATURE_VECTOR, path), DetectionConfig(), "1 hour")
    shown = []
    for i in range(3):
        part = [r for r in rows if at(6000 * i) <= r[1] < at(6000 * (i + 1))]
        random.Random(i).shuffle(part)
        feed(make_vectors(spark, part), path)
        shown.append(drain(stream, str(tmp_path / "out"), progress).count())
    assert 0 < shown[1] < shown[2]
    assert late_rows(progress) == 0
    feed(make_vectors(spark, [vector("s0", 300, error_rate=0.9)]), path)
    beat(spark, FEATURE_VECTOR, path, 10 * 86400)
    got = drain(stream, str(tmp_path / "out"), progress)
    assert late_rows(progress) > 0
    assert anomalies_key(got) == anomalies_key(detect.suppress(detect.feature_anomalies(make_vectors(spark, rows))))


def test_idle_services_are_forgotten(spark, tmp_path):
    """A service that was idle for longer than the limit warms up anew; one that wasn't keeps its history."""
    calm = [vector("s", 300 * i) for i in range(12)]
    spike = vector("s", 300 * 40, error_rate=0.5, error_count=50)
    for name, idle, found in (("long", 86400, True), ("short", 3600, False)):
        path = str(tmp_path / name)
        stream = stream_anomalies(source(spark, FEATURE_VECTOR, f"{path}/in"), DetectionConfig(), "1 minute", idle)
        feed(make_vectors(spark, calm), f"{path}/in")
        beat(spark, FEATURE_VECTOR, f"{path}/in", 300 * 30)
        assert drain(stream, path).count() == 0
        feed(make_vectors(spark, [spike]), f"{path}/in")
        beat(spark, FEATURE_VECTOR, f"{path}/in", 300 * 60)
        assert (drain(stream, path).count() > 0) is found


def test_every_window_of_streamed_features(spark, tmp_path):
    """Every closed window equals batch, none is missing; one window is hot."""
    r = random.Random(3)
    levels = ("INFO", "ERROR", "CRITICAL", "WARNING", "DEBUG")
    rows = [(r.choice([r.randint(0, 3000), r.randint(600, 899)]), r.choice(levels), r.choice("ab"), r.choice(["", f"h{r.randint(0, 400)}"]), r.choice([None, r.randint(1, 900)]), r.choice([None, "", f"E{r.randint(0, 9)}"])) for _ in range(4000)]
    logs = make_logs(spark, rows)
    path = str(tmp_path / "in")
    for part in logs.randomSplit([1.0, 1.0, 1.0], 4):
        feed(part, path)
    beat(spark, CANONICAL, path, 10 * 86400, "timestamp", level="INFO", message="m", message_hash="h")
    stream = stream_features(source(spark, CANONICAL, path), 300, "2 hours")
    assert "collect_set" not in stream._jdf.queryExecution().toString()
    got = drain(stream, str(tmp_path / "out")).where("service <> 'beat'")
    want = features.window_features(logs, 300)
    text = lambda df: sorted(str([(c, r[c]) for c in ("service", "window_start", *FEATURES)]) for r in df.collect())
    assert text(got) == text(want) and want.count() > 15


NAMES = ("error_rate", "max_duration_ms", "total_events", "warning_rate")
ANOMALIES = (
    "service string, window_start timestamp_ntz, feature string, ordinal int, observed double, baseline_mean double, baseline_std double, "
    "z_score double, rate_change double, score double, severity_rank int, direction string, suppressed boolean"
)


def make_anomalies(spark, rows):
    """rows: (service, seconds, feature, score, severity rank, suppressed)."""
    full = [(s, at(t), f, FEATURES.index(f), 1.0, 0.0, 1.0, 8.0, 1.0, x, k, "high", b) for s, t, f, x, k, b in rows]
    return spark.createDataFrame(full, ANOMALIES)


def some_anomalies(seed, n=60):
    r = random.Random(seed)
    times = [0]
    for _ in range(n):
        times.append(times[-1] + r.choice([300, 300, 600, 601, 900]))
    return [
        (s, t, f, r.randint(20, 100) / 100, r.randint(1, 4), i > 0 and r.random() < 0.5)
        for s in "ab" for t in times for i, f in enumerate(r.sample(NAMES, r.choice([1, 1, 2])))
    ]


def batch_incidents(anomalies, config):
    rows = anomalies.withColumn("baseline", F.struct(F.col("baseline_mean").alias("mean"), F.col("baseline_std").alias("std")))
    assigned = incidents.assign_incidents(detect.anomaly_events(rows), config)
    return incidents.incident_metrics(assigned, config)


def text_of(df):
    return sorted(str([(c, r[c]) for c in sorted(df.columns)]) for r in df.collect())


@pytest.mark.parametrize("overlap", [True, False])
def test_streamed_incidents_equal_batch(spark, tmp_path, overlap):
    """Shuffled triggers, restarts, and a last row that is suppressed."""
    config = IncidentConfig(require_feature_family_overlap=overlap)
    rows = some_anomalies(3)
    random.Random(5).shuffle(rows)
    path = str(tmp_path / "in")
    stream = stream_incidents(source(spark, ANOMALIES, path), config, "1 day")
    for i in range(3):
        feed(make_anomalies(spark, rows[i::3]), path)
        assert drain(stream, str(tmp_path / "out")).count() == 0  # nothing is closed yet
    beat(spark, ANOMALIES, path, 10 * 86400, suppressed=True)
    got = drain(stream, str(tmp_path / "out"))
    want = batch_incidents(make_anomalies(spark, rows), config)
    assert text_of(got) == text_of(want.drop("events")) and want.count() > (20 if overlap else 10)
    with pytest.raises(ValueError):
        stream_incidents(make_anomalies(spark, rows), IncidentConfig(merge_across_services=True))


def test_members_and_a_suppressed_tail(spark, tmp_path):
    """Events are assigned as they pass; a service whose last windows hold suppressed rows only doesn't stall."""
    rows = some_anomalies(4, 30)
    tail = [("a", 300 * i, "error_rate", 0.5, 2, True) for i in range(400, 500)]
    path = str(tmp_path / "in")
    feed(make_anomalies(spark, rows), path)
    feed(make_anomalies(spark, tail), path)
    every = make_anomalies(spark, rows)
    got = drain(stream_members(source(spark, ANOMALIES, path), IncidentConfig(), "12 hours"), str(tmp_path / "members"))
    want = batch_incidents(every, IncidentConfig()).select("incident_id", "service", F.explode("events").alias("e"))
    assert text_of(got) == text_of(want.select("e.event_id", "service", "e.window_start", "incident_id"))
    closed = drain(stream_incidents(source(spark, ANOMALIES, path), IncidentConfig(), "12 hours"), str(tmp_path / "closed"))
    assert text_of(closed) == text_of(batch_incidents(every, IncidentConfig()).drop("events"))
    events = drain(stream_events(source(spark, ANOMALIES, path), "12 hours"), str(tmp_path / "events"))
    assert events.count() == want.count()


def test_incident_state_does_not_grow_with_a_session(spark, tmp_path):
    """One incident of 2,000 events over many triggers: no row of state is longer than one of 20 events has."""
    sizes = {}
    for n in (20, 2000):
        path = str(tmp_path / f"{n}")
        rows = [("s", 300 * i, "error_rate", 0.5, 2, False) for i in range(n)]
        for i in range(0, n, max(n // 3, 1)):
            feed(make_anomalies(spark, rows[i : i + n // 3]), f"{path}/in")
        progress: list = []
        stream = stream_incidents(source(spark, ANOMALIES, f"{path}/in"), IncidentConfig(), "10 minutes")
        drain(stream, path, progress)
        sizes[n] = progress[-1].stateOperators[0].numRowsTotal
        beat(spark, ANOMALIES, f"{path}/in", 300 * n + 86400, suppressed=True)
        got = drain(stream, path).collect()
        assert [r.anomaly_count for r in got] == [n]
    assert sizes[2000] <= sizes[20] + 3


def test_scratch_folders_go(spark, tmp_path):
    with scratch(spark, "x") as path:
        spark.range(3).write.parquet(f"{path}/t")
        rows = kept(spark.read.parquet(f"{path}/t"))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(f"{path}/t")
    assert rows.count() == 3
