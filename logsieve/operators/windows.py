"""Tumbling windows by service. Windows start at multiples of their size since the epoch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import WindowConfig

KEYS = ("service", "window_start")


def window_start(ts: Column, seconds: int) -> Column:
    WindowConfig(seconds)
    return F.window(ts, f"{seconds} seconds").start


def with_window(logs: DataFrame, seconds: int = 300) -> DataFrame:
    """Adds window_start and window_end (exclusive)."""
    w = F.window("timestamp", f"{WindowConfig(seconds).seconds} seconds")
    return logs.withColumn("__w", w).withColumns({"window_start": F.col("__w.start"), "window_end": F.col("__w.end")}).drop("__w")


def log_counts(logs: DataFrame, seconds: int = 300) -> DataFrame:
    return with_window(logs, seconds).groupBy("service", "window_start", "window_end").agg(F.count(F.lit(1)).alias("log_count"))


def nested_windows(logs: DataFrame, seconds: int = 300) -> DataFrame:
    """Each window with its logs in time order. For windows known to be small: a window becomes one row."""
    entry = F.struct("timestamp", *(c for c in logs.columns if c not in ("timestamp", "service", "source_meta")))
    rows = with_window(logs, seconds).groupBy("service", "window_start", "window_end")
    return rows.agg(F.array_sort(F.collect_list(entry)).alias("logs"), F.count(F.lit(1)).alias("log_count"))


def services(windows: DataFrame) -> DataFrame:
    return windows.select("service").distinct()


def time_range(windows: DataFrame) -> DataFrame:
    """One row; both bounds are null without windows."""
    return windows.agg(F.min("window_start").alias("start_time"), F.max("window_end").alias("end_time"))


def windows_summary(windows: DataFrame) -> DataFrame:
    """Windows and logs of each service, and of all (service null), in order."""
    rows = windows.rollup("service").agg(
        F.count(F.lit(1)).alias("window_count"), F.sum("log_count").alias("log_count"), F.grouping("service").alias("__all")
    )
    return rows.orderBy("__all", "service").drop("__all")


def render_summary(summary: DataFrame) -> str:
    """Text of a summary; one line for each service."""
    rows = summary.collect()  # one row for each service
    each = [f"  {r.service}: {r.window_count} windows, {r.log_count} logs" for r in rows if r.service is not None]
    total = next((r for r in rows if r.service is None), None)
    head = "Windows: 0, logs: 0" if total is None else f"Windows: {total.window_count}, logs: {total.log_count or 0}"
    return "\n".join([head, *each])


def filter_service(windows: DataFrame, service: str) -> DataFrame:
    return windows.where(F.col("service") == service)


def filter_time(windows: DataFrame, start: str, end: str) -> DataFrame:
    """start <= window_start < end."""
    bound = lambda x: F.lit(x).cast("timestamp_ntz")
    return windows.where((F.col("window_start") >= bound(start)) & (F.col("window_start") < bound(end)))


def in_order(windows: DataFrame) -> DataFrame:
    return windows.orderBy("window_start", "service")


def by_time(windows: DataFrame) -> DataFrame:
    """Each time with its windows, sorted by service."""
    entry = F.struct("service", "log_count")
    return windows.groupBy("window_start").agg(F.array_sort(F.collect_list(entry)).alias("windows"))
