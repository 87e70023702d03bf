"""Parsed logs to canonical logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import normal
from ..schemas import MAX_ERROR_CODE, MAX_REQUEST_ID


def normalize_logs(parsed: DataFrame) -> DataFrame:
    """Canonical columns and reject_reason. Unknown or missing levels become INFO."""
    text = lambda c: F.col(c).cast("string")
    df = parsed.select(
        normal.timestamp(text("timestamp")).alias("timestamp"),
        F.coalesce(normal.level(text("level")), F.lit("INFO")).alias("level"),
        normal.service(text("service")).alias("service"),
        normal.message(text("message")).alias("message"),
        normal.duration(F.col("duration_ms")).alias("duration_ms"),
        normal.trimmed(text("error_code"), MAX_ERROR_CODE).alias("error_code"),
        normal.trimmed(text("request_id"), MAX_REQUEST_ID).alias("request_id"),
        *(["source_meta"] if "source_meta" in parsed.columns else []),
    )
    reason = (
        F.when(F.col("timestamp").isNull(), "bad timestamp")
        .when(F.col("service").isNull(), "bad service")
        .when(F.col("message").isNull(), "bad message")
    )
    return df.withColumns({"message_hash": normal.message_hash(F.col("message")), "reject_reason": reason})
