"""Raw rows to parsed logs. Rows that fail keep a ``reject_reason``; nothing is dropped silently.

Every parser returns timestamp, level, service, message, duration_ms, error_code,
request_id, source_meta (if the input has it) and reject_reason (null if parsed).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_filled, first_key, has_any_key, strip

# Fixed values of the text format.
TIMESTAMP_PATTERN = r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z?)"
TEXT_LEVELS = "DEBUG|INFO|WARNING|ERROR|CRITICAL|WARN|ERR|NOTICE"
LEVEL_PATTERN = rf"(?i)(?:^|\s)({TEXT_LEVELS})\s+"
AFTER_LEVEL_PATTERN = rf"(?is)^(?:.*?\s)??(?:{TEXT_LEVELS})\s+(.*)$"
SERVICE_PATTERN = r"^([a-zA-Z0-9_-]+)"
DURATION_PATTERN = r"\((\d+)m?s?\)"

# Names under which JSON logs carry a field; the first key present wins.
JSON_NAMES = {
    "timestamp": ("timestamp", "time", "ts", "@timestamp"),
    "level": ("level", "severity", "level_name", "log_level"),
    "service": ("service", "app", "component", "source"),
    "message": ("message", "msg", "text", "log_message"),
    "duration_ms": ("duration_ms", "duration", "latency_ms", "duration_milliseconds"),
}
# Names under which CSV logs carry a field; the first filled one wins.
CSV_NAMES = {
    "timestamp": ("timestamp", "time", "ts"),
    "level": ("level", "severity", "log_level"),
    "service": ("service", "app", "component"),
    "message": ("message", "msg", "text"),
    "duration_ms": ("duration_ms", "duration"),
}

Parser = Callable[[DataFrame], DataFrame]


def _whole_number(c: Column) -> Column:
    """Like int(): whole text, or the whole part of a JSON number."""
    d = strip(c).try_cast("double")
    return F.when(F.abs(d) < 9e18, F.when(d < 0, F.ceil(d)).otherwise(F.floor(d)).cast("bigint"))


def _finish(df: DataFrame, columns: dict[str, Column], reason: Column) -> DataFrame:
    null = F.lit(None).cast("string")
    columns = {"error_code": null, "request_id": null} | columns
    order = ("timestamp", "level", "service", "message", "duration_ms", "error_code", "request_id")
    meta = [F.col("source_meta")] if "source_meta" in df.columns else []
    return df.select(*(columns[c].alias(c) for c in order), *meta, reason.alias("reject_reason"))


def parse_text(raw: DataFrame) -> DataFrame:
    """``TIMESTAMP LEVEL SERVICE MESSAGE`` lines in ``value``."""
    line = strip(F.col("value"))
    df = raw.withColumn("__line", line).withColumn("__ts", F.regexp_extract("__line", TIMESTAMP_PATTERN, 1))
    df = df.withColumn("__rest", strip(F.expr("substring(__line, length(__ts) + 1)")))
    df = df.withColumns(
        {
            "__level": F.upper(F.regexp_extract("__rest", LEVEL_PATTERN, 1)),
            "__tail": F.regexp_extract("__rest", AFTER_LEVEL_PATTERN, 1),
        }
    ).withColumn("__service", F.regexp_extract("__tail", SERVICE_PATTERN, 1))
    said = strip(F.expr("substring(__tail, length(__service) + 1)"))
    df = df.withColumn(
        "__message", F.when(said == "", F.concat(F.lit("[No message] "), F.substring("__line", 1, 100))).otherwise(said)
    )
    duration = F.nullif(F.regexp_extract("__message", DURATION_PATTERN, 1), F.lit("")).try_cast("bigint")
    reason = (
        F.when(F.col("__line") == "", "empty line")
        .when(F.col("__ts") == "", "no timestamp")
        .when(F.col("__level") == "", "no level")
        .when(F.col("__service") == "", "no service")
    )
    columns = {
        "timestamp": F.col("__ts"),
        "level": F.col("__level"),
        "service": F.col("__service"),
        "message": F.col("__message"),
        "duration_ms": duration,
    }
    return _finish(df, columns, reason)


def parse_json(raw: DataFrame) -> DataFrame:
    """Objects in ``fields`` (a map; null if the line was none). A key with a null value is present: its text is 'None'."""
    fields = F.col("fields")
    as_text = lambda name: F.when(
        has_any_key(fields, JSON_NAMES[name]), F.coalesce(first_key(fields, JSON_NAMES[name]), F.lit("None"))
    )
    ts = first_key(fields, JSON_NAMES["timestamp"])
    reason = (
        F.when(fields.isNull(), "malformed JSON")
        .when(ts.isNull() | (ts == ""), "no timestamp")
        .when(~has_any_key(fields, JSON_NAMES["message"]), "no message")
    )
    columns = {
        "timestamp": ts,
        "level": F.upper(as_text("level")),
        "service": as_text("service"),
        "message": as_text("message"),
        "duration_ms": _whole_number(first_key(fields, JSON_NAMES["duration_ms"])),
    }
    return _finish(raw, columns, reason)


def parse_csv(raw: DataFrame) -> DataFrame:
    """Rows in ``fields`` (a map from header to text)."""
    pick = lambda name: first_filled(F.col("fields"), CSV_NAMES[name])
    reason = F.when(pick("timestamp").isNull(), "no timestamp").when(pick("message").isNull(), "no message")
    columns = {
        "timestamp": pick("timestamp"),
        "level": F.upper(pick("level")),
        "service": pick("service"),
        "message": pick("message"),
        "duration_ms": strip(pick("duration_ms")).try_cast("bigint"),
    }
    return _finish(raw, columns, reason)


def parse_logs(raw: DataFrame, parser: Parser | None = None) -> DataFrame:
    """Parses raw rows by their shape: ``value`` is text; ``fields`` is CSV or JSON by source_meta.format."""
    if parser is not None:
        return parser(raw)
    if "value" in raw.columns:
        return parse_text(raw)
    if "source_meta" not in raw.columns:
        return parse_json(raw)
    is_csv = F.col("source_meta.format") == "csv"
    return parse_csv(raw.where(is_csv)).unionByName(parse_json(raw.where(~is_csv)))


def accepted(rows: DataFrame) -> DataFrame:
    """Rows without a reject_reason, and without that column.

    One row or none is unfolded from each: a filter would be pushed down with every expression that the
    reason is computed from, and evaluate all of them again.
    """
    kept = F.struct(*(c for c in rows.columns if c != "reject_reason"))
    return rows.select(F.inline(F.when(F.col("reject_reason").isNull(), F.array(kept))))


def quality_report(rows: DataFrame) -> DataFrame:
    """One row: total, accepted and skipped rows."""
    bad = F.col("reject_reason").isNotNull()
    return rows.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~bad).alias("accepted"), F.count_if(bad).alias("skipped")
    )
