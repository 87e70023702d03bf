"""Names, orders and Spark schemas of the data model. Timestamps are TIMESTAMP_NTZ in UTC."""

from __future__ import annotations

# Log levels.
LEVELS = ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL")
# Severities in rising order.
SEVERITIES = ("none", "low", "medium", "high", "critical")
# The eleven features in their order, by family.
FAMILIES = {
    "count": ("total_events", "error_count", "warning_count", "info_count"),
    "rate": ("error_rate", "warning_rate"),
    "duration": ("median_duration_ms", "p95_duration_ms", "max_duration_ms"),
    "diversity": ("unique_messages", "unique_error_codes"),
}
FEATURES = tuple(f for group in FAMILIES.values() for f in group)
FAMILY_NAMES = (*FAMILIES, "other")
# Bounds of text fields, in characters.
MAX_SERVICE, MAX_MESSAGE, MAX_ERROR_CODE, MAX_REQUEST_ID = 128, 2048, 64, 128

SOURCE_META = "struct<source:string,line_number:bigint,idx:bigint,format:string>"
RAW_TEXT = f"value string, source_meta {SOURCE_META}"
RAW_FIELDS = f"fields map<string,string>, source_meta {SOURCE_META}"
PARSED = "timestamp string, level string, service string, message string, duration_ms bigint"
CANONICAL = (
    "timestamp timestamp_ntz, level string, service string, message string, message_hash string, "
    "duration_ms bigint, error_code string, request_id string"
)
FEATURE_VECTOR = (
    "service string, window_start timestamp_ntz, total_events bigint, error_count bigint, warning_count bigint, "
    "info_count bigint, error_rate double, warning_rate double, median_duration_ms double, p95_duration_ms double, "
    "max_duration_ms double, unique_messages bigint, unique_error_codes bigint"
)
OPERATIONAL_EVENT = "event_type string, timestamp timestamp_ntz, description string, metadata map<string,string>"
EXPLANATION = (
    "incident_id string, summary string, probable_causes array<string>, supporting_evidence array<string>, "
    "confidence_score double, recommended_next_steps array<string>, limitations string"
)
TRAINING_SAMPLE = f"incident string, explanation struct<{', '.join(f'{n}:{t}' for n, t in (x.split(' ') for x in EXPLANATION.split(', ')))}>"


def family_of(feature: str) -> str:
    return next((name for name, group in FAMILIES.items() if feature in group), "other")
