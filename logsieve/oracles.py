"""DuckDB forms of the query catalogue: one chain of common table expressions, and a final select each."""

from __future__ import annotations

# Fixed values of the contract, written out here so that an error in the library's own can't hide on both sides.
LEVEL_ALIASES = {
    "DEBUG": "DEBUG", "INFO": "INFO", "WARNING": "WARNING", "WARN": "WARNING", "ERROR": "ERROR", "ERR": "ERROR",
    "CRITICAL": "CRITICAL", "CRIT": "CRITICAL", "FATAL": "CRITICAL",
}
SEVERITIES = ("none", "low", "medium", "high", "critical")
FAMILIES = {
    "count": ("total_events", "error_count", "warning_count", "info_count"),
    "rate": ("error_rate", "warning_rate"),
    "duration": ("median_duration_ms", "p95_duration_ms", "max_duration_ms"),
    "diversity": ("unique_messages", "unique_error_codes"),
}
FAMILY_NAMES = ("count", "rate", "duration", "diversity", "other")
FEATURES = (
    "total_events", "error_count", "warning_count", "info_count", "error_rate", "warning_rate", "median_duration_ms",
    "p95_duration_ms", "max_duration_ms", "unique_messages", "unique_error_codes",
)
MAX_SERVICE, MAX_MESSAGE = 128, 2048
MESSAGE_BLANKS = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
TIMESTAMP_PATTERN = r"^([0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z?)"
LEVEL_PATTERN = r"(?i)(?:^|\s)(DEBUG|INFO|WARNING|ERROR|CRITICAL|WARN|ERR|NOTICE)\s+"
AFTER_LEVEL_PATTERN = r"(?is)^(?:.*?\s)??(?:DEBUG|INFO|WARNING|ERROR|CRITICAL|WARN|ERR|NOTICE)\s+(.*)$"
SERVICE_PATTERN = r"^([A-Za-z0-9_-]+)"
DURATION_PATTERN = r"\(([0-9]+)m?s?\)"
CAUSES = {
    "error_rate_spike": ("error_rate", "error_count"),
    "warning_spike": ("warning_rate", "warning_count"),
    "latency_regression": ("median_duration_ms", "p95_duration_ms", "max_duration_ms"),
    "traffic_spike": ("total_events", "info_count"),
    "error_variation": ("unique_messages", "unique_error_codes"),
}
STEPS = (
    (("deployment_change",), "Review recent deployments in the incident window"),
    (("error_rate_spike", "warning_spike"), "Inspect error and warning logs for the affected service"),
    (("latency_regression",), "Check latency metrics and downstream dependencies"),
    (("traffic_spike",), "Verify traffic sources and request patterns"),
    (("error_variation",), "Group errors by code to identify new patterns"),
)
ALWAYS_STEP = "Validate incident scope and confirm if impact persists"
FALLBACK_SUMMARY = "Incident explanation unavailable; fallback generated from known facts."
FALLBACK_LIMITS = "LLM output was invalid or unavailable; returned minimal factual summary."
FALLBACK_CONFIDENCE = 0.1

SECONDS, GAP, CONTEXT = 21600, 43200, 21600
WINDOW = f"time_bucket(INTERVAL '{SECONDS} seconds', timestamp, TIMESTAMP '1970-01-01')"
LEVEL = "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARNING' WHEN 'view' THEN 'DEBUG' ELSE 'INFO' END"
BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ISO = "'%Y-%m-%dT%H:%M:%S'"


def _message(c: str) -> str:
    return f"nullif(substr(trim(regexp_replace({c}, '{MESSAGE_BLANKS}', ' ', 'g'), ' '), 1, {MAX_MESSAGE}), '')"


def _case(names, what: str, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {what} {test} THEN {value}" for test, value in names) + f" ELSE {default} END"


def _in(names) -> str:
    return "IN (" + ", ".join(f"'{n}'" for n in names) + ")"


def _rank(value: str, limits: tuple) -> str:
    return f"CASE WHEN abs({value}) >= {limits[3]} THEN 4 WHEN abs({value}) >= {limits[2]} THEN 3 WHEN abs({value}) >= {limits[1]} THEN 2 WHEN abs({value}) >= {limits[0]} THEN 1 ELSE 0 END"


FAMILY = _case([(_in(group), f"'{name}'") for name, group in FAMILIES.items()], "feature", "'other'")
ORDINAL = _case([(f"= '{f}'", str(i)) for i, f in enumerate(FEATURES)], "feature", "NULL")
FAMILY_BIT = _case([(f"= '{name}'", str(1 << i)) for i, name in enumerate(FAMILY_NAMES)], "family", "0")
NAME = lambda rank: f"list_extract([{', '.join(repr(s) for s in SEVERITIES)}], {rank} + 1)"
HASH = "substr(sha256(message), 1, 16)"
TIME_TEXT = lambda c: f"strftime({c}, '%Y-%m-%d %H:%M:%S')"
ID = lambda service, time: f"substr(sha256({service} || '|' || {TIME_TEXT(time)}), 1, 32)"

LOGS = f"""
logs AS (SELECT ts AS timestamp, 'svc-' || (user_id % 5) AS service, {LEVEL} AS level, {_message("event_type || ' ' || props")} AS message,
    CASE WHEN value >= 1 THEN CAST(floor(value) AS BIGINT) END AS duration_ms,
    CASE WHEN event_type = 'error' THEN 'E' || json_extract_string(props, '$.k') END AS error_code, 'req-' || event_id AS request_id FROM events),
counted AS (SELECT service, {WINDOW} AS window_start, {WINDOW} + INTERVAL '{SECONDS} seconds' AS window_end, count(*) AS log_count
    FROM logs GROUP BY ALL),
vectors AS (SELECT service, {WINDOW} AS window_start, count(*) AS total_events,
    count(*) FILTER (WHERE level IN ('ERROR', 'CRITICAL')) AS error_count, count(*) FILTER (WHERE level = 'WARNING') AS warning_count,
    count(*) FILTER (WHERE level = 'INFO') AS info_count,
    count(*) FILTER (WHERE level IN ('ERROR', 'CRITICAL')) / count(*)::DOUBLE AS error_rate,
    count(*) FILTER (WHERE level = 'WARNING') / count(*)::DOUBLE AS warning_rate, median(duration_ms)::DOUBLE AS median_duration_ms,
    list_extract(list_sort(list(duration_ms) FILTER (WHERE duration_ms IS NOT NULL)),
        CAST(least(floor(0.95::DOUBLE * count(duration_ms)), count(duration_ms) - 1) AS INT) + 1)::DOUBLE AS p95_duration_ms,
    max(duration_ms)::DOUBLE AS max_duration_ms, count(DISTINCT {HASH}) AS unique_messages,
    count(DISTINCT nullif(error_code, '')) AS unique_error_codes FROM logs GROUP BY ALL),
long AS (SELECT service, window_start, u.feature AS feature, u.x AS observed FROM (SELECT service, window_start,
    unnest([{", ".join(f"{{'feature': '{f}', 'x': {f}::DOUBLE}}" for f in FEATURES)}]) AS u FROM vectors) WHERE u.x IS NOT NULL),
numbered AS (SELECT *, row_number() OVER w AS rn, lag(observed) OVER w AS previous, avg(observed) OVER r AS r_mean,
    greatest(stddev_pop(observed) OVER r, 1e-6) AS r_std, count(*) OVER r AS r_count FROM long
    WINDOW w AS (PARTITION BY service, feature ORDER BY window_start),
           r AS (PARTITION BY service, feature ORDER BY window_start ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
ewma AS (SELECT service, feature, rn, observed AS m, 0.0::DOUBLE AS v FROM numbered WHERE rn = 1 UNION ALL
    SELECT n.service, n.feature, n.rn, 0.2::DOUBLE * n.observed + 0.8::DOUBLE * e.m,
      0.2::DOUBLE * power(n.observed - (0.2::DOUBLE * n.observed + 0.8::DOUBLE * e.m), 2) + 0.8::DOUBLE * e.v
    FROM ewma e JOIN numbered n ON n.service = e.service AND n.feature = e.feature AND n.rn = e.rn + 1),
based AS (SELECT n.*, e.m AS e_mean, greatest(sqrt(e.v), 1e-6) AS e_std, n.rn - 1 AS e_count FROM numbered n
    LEFT JOIN ewma e ON e.service = n.service AND e.feature = n.feature AND e.rn = n.rn - 1),
hybrid AS (SELECT *, r_mean AS mean, greatest(r_std, e_std) AS std, least(r_count, e_count) AS count FROM based WHERE r_count >= 10),
measured AS (SELECT *, CASE WHEN std >= 1e-6 THEN (observed - mean) / std END AS z_score,
    abs(observed - previous) / greatest(abs(previous), 1e-6) AS rate_change FROM hybrid),
scored AS (SELECT *, {ORDINAL} AS ordinal, {FAMILY} AS family,
    round(greatest(0.0, least(1.0, 0.7::DOUBLE * coalesce(least(abs(z_score) / 7.0::DOUBLE, 1.0), 0.0) + 0.3::DOUBLE * coalesce(least(abs(rate_change) / 3.0::DOUBLE, 1.0), 0.0))), 12) AS score,
    greatest({_rank("z_score", (2.5, 3.5, 5.0, 7.0))}, {_rank("rate_change", (0.75, 1.25, 2.0, 3.0))}) AS severity_rank,
    CASE WHEN observed >= mean THEN 'high' ELSE 'low' END AS direction FROM measured),
anomalies AS (SELECT *, row_number() OVER (PARTITION BY service, window_start, family ORDER BY score DESC, ordinal) AS place
    FROM scored WHERE score >= 0.2 AND severity_rank > 0),
active AS (SELECT * FROM anomalies WHERE place = 1),
found AS (SELECT {ID("service", "window_start")} AS event_id, service, window_start, max(score) AS score, max(severity_rank) AS severity_rank,
    string_agg(feature, ',' ORDER BY ordinal) AS features, bit_or({FAMILY_BIT}) AS mask, list(feature) AS feature_list,
    list(direction) AS directions, bit_or(1 << ordinal) AS feature_bits,
    {", ".join(f"count(*) FILTER (WHERE severity_rank = {r}) AS n_{s}" for r, s in enumerate(SEVERITIES) if r)}
    FROM active GROUP BY service, window_start),
gaps AS (SELECT *, CASE WHEN epoch(window_start) - epoch(lag(window_start) OVER (PARTITION BY service ORDER BY window_start)) <= {GAP} THEN 0 ELSE 1 END AS opens,
    row_number() OVER (PARTITION BY service ORDER BY window_start) AS rn FROM found),
sessions AS (SELECT *, sum(opens) OVER (PARTITION BY service ORDER BY window_start) AS session FROM gaps),
chain AS (SELECT service, rn, mask AS seen, 0 AS part FROM gaps WHERE rn = 1 UNION ALL
    SELECT g.service, g.rn, CASE WHEN g.opens = 0 AND (c.seen & g.mask) <> 0 THEN c.seen | g.mask ELSE g.mask END,
      c.part + CASE WHEN g.opens = 0 AND (c.seen & g.mask) <> 0 THEN 0 ELSE 1 END FROM chain c JOIN gaps g ON g.service = c.service AND g.rn = c.rn + 1),
grouped AS (SELECT g.*, c.part FROM gaps g JOIN chain c USING (service, rn)),
incidents AS (SELECT {ID("service", "min(window_start)")} AS incident_id, service, min(window_start) AS start_time,
    max(window_start) + INTERVAL '{SECONDS} seconds' AS end_time, count(*) AS anomaly_count, bit_count(bit_or(feature_bits))::BIGINT AS feature_count,
    max(score) AS max_score, max(severity_rank) AS severity_rank, {", ".join(f"sum(n_{s})::BIGINT AS n_{s}" for s in SEVERITIES[1:])},
    list_distinct(flatten(list(feature_list))) AS features, list_distinct(flatten(list(directions))) AS directions,
    list_distinct(list(severity_rank)) AS ranks, list(window_start) AS starts
    FROM grouped GROUP BY service, part),
wide AS (SELECT *, start_time - INTERVAL '{CONTEXT} seconds' AS lo, end_time + INTERVAL '{CONTEXT} seconds' AS hi FROM incidents),
patterns AS (SELECT incident_id, {HASH} AS key, count(*) AS count, arg_min(message, (timestamp, request_id)) AS sample_message, min((timestamp, request_id)) AS seen
    FROM wide JOIN logs ON logs.service = wide.service AND timestamp BETWEEN lo AND hi GROUP BY ALL),
top_patterns AS (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY count DESC, seen, key) AS place FROM patterns QUALIFY place <= 10),
operations AS (SELECT 'deploy-' || (user_id % 3) AS event_type, ts AS timestamp, 'event ' || event_id AS description FROM events WHERE event_type = 'signup'),
context AS (SELECT incident_id, event_type, timestamp, description,
    row_number() OVER (PARTITION BY incident_id ORDER BY timestamp, event_type, description) AS place
    FROM wide JOIN operations ON timestamp BETWEEN lo AND hi QUALIFY place <= 10),
causes AS (SELECT i.*, list_sort(list_distinct(list_concat(['unknown'],
    {", ".join(f"CASE WHEN len(list_intersect(features, [{', '.join(repr(n) for n in names)}])) > 0 THEN ['{c}'] ELSE [] END" for c, names in CAUSES.items())},
    CASE WHEN EXISTS (SELECT 1 FROM context c WHERE c.incident_id = i.incident_id AND lower(event_type) LIKE '%deploy%') THEN ['deployment_change'] ELSE [] END))) AS allowed_causes FROM incidents i),
steps AS (SELECT *, list_sort(list_distinct(list_concat(['{ALWAYS_STEP}'],
    {", ".join(f"CASE WHEN len(list_intersect(allowed_causes, [{', '.join(repr(n) for n in names)}])) > 0 THEN ['{step}'] ELSE [] END" for names, step in STEPS)}))) AS allowed_steps FROM causes),
ev AS (SELECT incident_id, unnest(list_concat(['service=' || service, 'start_time=' || strftime(start_time, {ISO}) || '+00:00', 'end_time=' || strftime(end_time, {ISO}) || '+00:00',
      'max_score=' || printf('%.2f', max_score)],
    list_transform(starts, lambda x: 'window_start=' || strftime(x, {ISO}) || '+00:00'), list_transform(ranks, lambda r: 'severity=' || {NAME("r")}),
    list_transform(features, lambda f: 'feature=' || f), list_transform(directions, lambda f: 'direction=' || f))) AS e FROM incidents
  UNION ALL SELECT incident_id, 'log_pattern=' || key || '|count=' || count FROM top_patterns
  UNION ALL SELECT incident_id, 'op_event=' || event_type || '|time=' || strftime(timestamp, {ISO}) ||
    CASE WHEN microsecond(timestamp) % 1000000 = 0 THEN '' ELSE strftime(timestamp, '.%f') END || '+00:00' FROM context),
evidence AS (SELECT incident_id, list_sort(list_distinct(list(e))) AS allowed_evidence FROM ev GROUP BY incident_id)"""

# Fixed value: the head of every prompt.
PROMPT_HEAD = (
    "You are a reliability assistant. Use ONLY the incident data and allowed lists.\n"
    'INSTRUCTIONS: {"constraints": ["Return a single JSON object only.", "Do NOT include any text outside JSON.", '
    '"Use only allowed values for probable_causes, supporting_evidence, and recommended_next_steps.", '
    '"Do NOT invent facts beyond the incident data.", "If uncertain, state limitations clearly."], '
    '"schema": {"confidence_score": "float in [0,1]", "incident_id": "string", "limitations": "string", '
    '"probable_causes": "list[string]", "recommended_next_steps": "list[string]", "summary": "string", '
    '"supporting_evidence": "list[string]"}, "task": "Explain the incident using only provided facts."}\n'
    "INCIDENT: "
)


def _text(c: str) -> str:
    """JSON text of a string of printable ASCII."""
    return f"""'"' || replace(replace({c}, '\\', '\\\\'), '"', '\\"') || '"'"""


def _number(c: str, cap: bool = False) -> str:
    value = f"greatest(least({c}, 1000.0), -1000.0)" if cap else c
    return f"coalesce(round({value}, 6)::DOUBLE::VARCHAR, 'null')"


def _time(c: str) -> str:
    fraction = f"CASE WHEN microsecond({c}) % 1000000 = 0 THEN '' ELSE strftime({c}, '.%f') END"
    return f"""'"' || strftime({c}, '%Y-%m-%d %H:%M:%S') || {fraction} || '+00:00"'"""


def _object(**fields: str) -> str:
    return "'{' || " + " || ', ' || ".join(f"""'"{k}": ' || {v}""" for k, v in sorted(fields.items())) + " || '}'"


def _list(items: str) -> str:
    return f"'[' || coalesce({items}, '') || ']'"


def _strings(c: str) -> str:
    return f"'[' || array_to_string(list_transform({c}, lambda x: {_text('x')}), ', ') || ']'"


_ANOMALY = _object(
    baseline_mean=_number("mean"), baseline_std=_number("std"), direction=_text("direction"), feature=_text("feature"), observed=_number("observed"),
    rate_change=_number("rate_change", True), score=_number("score"), severity=_text(NAME("severity_rank")), suppressed="'false'",
    suppression_reason="'null'", z_score=_number("z_score", True),
)
_EVENT = _object(
    anomalies="text", event_id=_text("event_id"), score=_number("score"), service=_text("service"), severity=_text(NAME("severity_rank")),
    window_start=_time("window_start"),
)
_PATTERN = _object(count="count::VARCHAR", key=_text("key"), sample_message=_text("sample_message"))
_OPERATION = _object(description=_text("description"), event_type=_text("event_type"), metadata="'{}'", timestamp=_time("timestamp"))
_COUNT = ", ".join(f"""CASE WHEN n_{s} > 0 THEN '"{s}": ' || n_{s} END""" for s in sorted(SEVERITIES[1:]))
_METRICS = _object(
    anomaly_count="anomaly_count::VARCHAR", feature_count="feature_count::VARCHAR", max_score=_number("max_score"),
    severity_counts=f"'{{' || array_to_string(list_filter([{_COUNT}], lambda x: x IS NOT NULL), ', ') || '}}'",
)
_INCIDENT = _object(
    anomalies="anomalies", end_time=_time("end_time"), incident_id=_text("i.incident_id"), log_patterns="coalesce(log_patterns, '[]')",
    metrics_summary=_METRICS, operational_context="coalesce(operational_context, '[]')", service=_text("service"), start_time=_time("start_time"),
)
_COMPLETION = _object(
    confidence_score=f"'{FALLBACK_CONFIDENCE}'", incident_id=_text("incident_id"), limitations=_text(f"'{FALLBACK_LIMITS}'"),
    probable_causes="""'["unknown"]'""", recommended_next_steps=_strings(f"['{ALWAYS_STEP}']"), summary=_text(f"'{FALLBACK_SUMMARY}'"),
    supporting_evidence=_strings("allowed_evidence[1:3]"),
)
_BREAK = "' || chr(10) || '"
PROMPTS = f"""
, anomaly_texts AS (SELECT service, window_start, {_list(f"string_agg({_ANOMALY}, ', ' ORDER BY ordinal)")} AS text FROM active GROUP BY ALL),
event_texts AS (SELECT f.service, f.window_start, {_EVENT} AS text FROM found f JOIN anomaly_texts USING (service, window_start)),
event_lists AS (SELECT incident_id, {_list("string_agg(text, ', ' ORDER BY window_start)")} AS anomalies
    FROM incidents i JOIN event_texts e ON e.service = i.service AND list_contains(i.starts, e.window_start) GROUP BY incident_id),
pattern_lists AS (SELECT incident_id, {_list(f"string_agg({_PATTERN}, ', ' ORDER BY place)")} AS log_patterns FROM top_patterns GROUP BY incident_id),
context_lists AS (SELECT incident_id, {_list(f"string_agg({_OPERATION}, ', ' ORDER BY place)")} AS operational_context FROM context GROUP BY incident_id),
prompts AS (SELECT i.incident_id, '{PROMPT_HEAD}' || {_INCIDENT} || '{_BREAK}ALLOWED_CAUSES: ' || {_strings("allowed_causes")}
    || '{_BREAK}ALLOWED_EVIDENCE: ' || {_strings("allowed_evidence")} || '{_BREAK}ALLOWED_STEPS: ' || {_strings("allowed_steps")}
    || '{_BREAK}RETURN_JSON_ONLY:' AS prompt, allowed_evidence
    FROM steps i JOIN evidence e ON e.incident_id = i.incident_id JOIN event_lists l ON l.incident_id = i.incident_id
    LEFT JOIN pattern_lists p ON p.incident_id = i.incident_id LEFT JOIN context_lists c ON c.incident_id = i.incident_id)"""

TEXT = f"""
lines AS (SELECT event_id, trim((CASE WHEN event_id % 17 = 0 THEN 'no time' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END) || ' ' ||
    (CASE WHEN event_id % 19 = 0 THEN '' WHEN event_id % 5 = 0 THEN lower({LEVEL}) ELSE {LEVEL} END) || ' svc-' || (user_id % 5) ||
    (CASE WHEN event_id % 23 = 0 THEN '' ELSE ' ' || event_type || ' ' || props || ' (' || CAST(floor(abs(value)) AS BIGINT) || 'ms)' END), {BLANKS}) AS line FROM events),
timed AS (SELECT *, regexp_extract(line, '{TIMESTAMP_PATTERN}', 1) AS t FROM lines),
rest AS (SELECT *, trim(substr(line, length(t) + 1), {BLANKS}) AS r FROM timed),
leveled AS (SELECT *, upper(regexp_extract(r, '{LEVEL_PATTERN}', 1)) AS l, regexp_extract(r, '{AFTER_LEVEL_PATTERN}', 1) AS tail FROM rest),
served AS (SELECT *, regexp_extract(tail, '{SERVICE_PATTERN}', 1) AS s FROM leveled),
parsed AS (SELECT *, CASE WHEN trim(substr(tail, length(s) + 1), {BLANKS}) = '' THEN '[No message] ' || substr(line, 1, 100) ELSE trim(substr(tail, length(s) + 1), {BLANKS}) END AS m,
    CASE WHEN line = '' THEN 'empty line' WHEN t = '' THEN 'no timestamp' WHEN l = '' THEN 'no level' WHEN s = '' THEN 'no service' END AS reason FROM served)"""

JSON = f"""
picked AS (SELECT event_id, CASE event_id % 3 WHEN 2 THEN 'NONE' ELSE {LEVEL} END AS level,
    CASE event_id % 3 WHEN 2 THEN 'c' ELSE 'svc-' || (user_id % 5) END AS service, event_type AS message,
    CASE event_id % 3 WHEN 0 THEN CAST(floor(value) AS BIGINT) END AS duration_ms FROM events WHERE NOT (event_id % 3 = 2 AND event_id % 5 = 0))"""


def _vectors(*names: str) -> str:
    shown = [f"round({n}, 6) AS {n}" if n in FAMILIES["rate"] + FAMILIES["duration"] else n for n in names]
    return f"SELECT service, window_start, {', '.join(shown)} FROM vectors"


def _levels() -> str:
    form = "CASE event_id % 7 WHEN 0 THEN ' warn ' WHEN 1 THEN 'Err' WHEN 2 THEN 'CRIT' WHEN 3 THEN 'fatal' WHEN 4 THEN 'info' WHEN 5 THEN 'NOTICE' ELSE event_type END"
    return f"SELECT event_id, {_case([(repr(k).join(['= ', '']), repr(v)) for k, v in LEVEL_ALIASES.items()], 'upper(trim(x))', 'NULL')} AS level FROM (SELECT event_id, {form} AS x FROM events)"


def _top(order: str) -> str:
    return f"""SELECT id, {NAME('severity_rank')} AS severity FROM (SELECT {ID("service", "window_start")} || ':' || feature AS id, service, window_start, severity_rank,
        greatest(least(round(coalesce(nullif(z_score, 0), nullif(rate_change, 0), 0), 6), 1000.0), -1000.0) AS deviation FROM active) ORDER BY {order}, id LIMIT 20"""


KEYS = "service, window_start, feature"
WITH = f"WITH RECURSIVE {LOGS} "
CHAINED = {
    "window_log_counts": "SELECT * FROM counted",
    "window_services": "SELECT DISTINCT service FROM counted",
    "window_time_range": "SELECT min(window_start) AS start_time, max(window_end) AS end_time FROM counted",
    "window_summary": "SELECT service, count(*) AS window_count, sum(log_count)::BIGINT AS log_count FROM counted GROUP BY ROLLUP (service)",
    "filter_windows_service": "SELECT * FROM counted WHERE service = 'svc-3'",
    "filter_windows_time": "SELECT * FROM counted WHERE window_start >= TIMESTAMP '2024-01-05 00:00:00' AND window_start < TIMESTAMP '2024-01-12 12:00:00'",
    "windows_by_time": "SELECT window_start, string_agg(service || ':' || log_count, ',' ORDER BY service) AS windows FROM counted GROUP BY 1",
    "nested_window_sizes": f"SELECT service, {WINDOW} AS window_start, count(*) AS n, min(timestamp) AS first_log FROM logs GROUP BY ALL",
    "count_features": _vectors(*FAMILIES["count"]),
    "rate_features": _vectors(*FAMILIES["rate"]),
    "duration_features": _vectors(*FAMILIES["duration"]),
    "diversity_features": _vectors(*FAMILIES["diversity"]),
    "feature_vectors": _vectors(*FEATURES),
    "feature_statistics": "SELECT round(min(x), 6) AS min, round(max(x), 6) AS max, round(avg(x), 6) AS mean, round(median(x), 6) AS median, round(coalesce(stddev_samp(x), 0), 6) AS stdev FROM (SELECT max_duration_ms AS x FROM vectors)",
    "compare_to_baseline": "SELECT service, window_start, error_count FROM vectors WHERE error_count > 1.5 * (SELECT avg(error_count) FROM vectors)",
    "features_long": f"SELECT {KEYS}, round(observed, 6) AS observed FROM long",
    "rolling_baseline": f"SELECT {KEYS}, round(r_mean, 6) AS mean, round(r_std, 6) AS std, r_count AS count FROM numbered WHERE r_count >= 10",
    "ewma_baseline": f"SELECT {KEYS}, round(e_mean, 6) AS mean, round(e_std, 6) AS std, e_count AS count FROM based WHERE e_count >= 10",
    "hybrid_baseline": f"SELECT {KEYS}, round(mean, 6) AS mean, round(std, 6) AS std, count FROM hybrid",
    "previous_value": f"SELECT {KEYS}, round(observed, 6) AS observed, round(previous, 6) AS previous FROM numbered",
    "zscore": f"SELECT {KEYS}, round(CASE WHEN abs(z_score) > 1000 THEN sign(z_score) * 1000.0 ELSE z_score END, 6) AS z_score FROM scored",
    "rate_of_change": f"SELECT {KEYS}, round(least(rate_change, 1000.0), 6) AS rate_change FROM scored",
    "combined_score": f"SELECT {KEYS}, round(score, 6) AS score FROM scored",
    "severity_mapping": f"SELECT {KEYS}, {NAME('severity_rank')} AS severity FROM scored",
    "feature_anomalies": f"SELECT {KEYS}, round(observed, 6) AS observed, round(score, 6) AS score, {NAME('severity_rank')} AS severity, direction FROM anomalies",
    "suppressed_anomalies": f"SELECT {KEYS}, family, round(score, 6) AS score, 'suppressed_by_' || family || '_family' AS suppression_reason FROM anomalies WHERE place > 1",
    "active_anomalies": f"SELECT {KEYS}, family, round(score, 6) AS score FROM active",
    "anomaly_events": f"SELECT event_id, service, window_start, {NAME('severity_rank')} AS severity, round(score, 6) AS score, features FROM found",
    "anomaly_rows": f"""SELECT {ID("service", "window_start")} || ':' || feature AS id, service, window_start AS timestamp, feature, round(observed, 6) AS observed,
        round(d, 6) AS deviation, round(score, 6) AS score, {NAME('severity_rank')} AS severity, CASE WHEN d > 5 THEN 'critical' WHEN d > 1 THEN 'high' ELSE 'medium' END AS class
        FROM (SELECT *, greatest(least(coalesce(nullif(z_score, 0), nullif(rate_change, 0), 0), 1000.0), -1000.0) AS d FROM active)""",
    "top_anomalies": _top("severity_rank DESC"),
    "latest_anomalies": _top("window_start DESC"),
    "anomalies_by_service": _top("service ASC"),
    "most_deviant_anomalies": _top("deviation DESC"),
    "incidents_gap": f"""SELECT {ID("service", "min(window_start)")} AS incident_id, service, min(window_start) AS start_time, max(window_start) + INTERVAL '{SECONDS} seconds' AS end_time,
        count(*) AS anomaly_count FROM sessions GROUP BY service, session""",
    "incidents_overlap": "SELECT incident_id, service, start_time, end_time, anomaly_count FROM incidents",
    "incident_metrics": "SELECT incident_id, anomaly_count, feature_count, round(max_score, 6) AS max_score, n_low, n_medium, n_high, n_critical FROM incidents",
    "incident_log_patterns": "SELECT incident_id, key, count, sample_message, place FROM top_patterns",
    "incident_op_context": "SELECT * FROM context",
    "incident_rows": f"""SELECT incident_id AS id, service, start_time AS timestamp, {NAME('severity_rank')} AS severity,
        service || ' incident with ' || anomaly_count || ' anomaly windows detected.' AS description, 'open' AS status FROM incidents""",
    "allowed_causes": "SELECT incident_id, array_to_string(allowed_causes, ';') AS allowed_causes FROM causes",
    "allowed_steps": "SELECT incident_id, array_to_string(allowed_steps, ';') AS allowed_steps FROM steps",
    "allowed_evidence": "SELECT incident_id, array_to_string(allowed_evidence, ';') AS allowed_evidence FROM evidence",
    "fallback_explanations": f"""SELECT incident_id, '{FALLBACK_SUMMARY}' AS summary, 'unknown' AS causes, array_to_string(allowed_evidence[1:3], ';') AS evidence,
        {FALLBACK_CONFIDENCE}::DOUBLE AS confidence, '{ALWAYS_STEP}' AS steps, '{FALLBACK_LIMITS}' AS limitations FROM evidence""",
    "explanation_rows": f"""SELECT incident_id, '{FALLBACK_SUMMARY}' AS what_happened, 'unknown' AS likely_cause, {FALLBACK_CONFIDENCE}::DOUBLE AS confidence,
        '{ALWAYS_STEP}' AS suggested_actions, service AS affected_services FROM incidents""",
    "streaming_detect": f"SELECT {KEYS}, round(score, 6) AS score FROM active",
    "streaming_incidents": "SELECT incident_id, service, start_time, end_time, anomaly_count FROM incidents",
}

ORACLES = {name: WITH + sql for name, sql in CHAINED.items()} | {
    "prompts": f"{WITH}{PROMPTS} SELECT incident_id, prompt FROM prompts",
    "training_pairs": f"{WITH}{PROMPTS} SELECT incident_id, prompt, {_COMPLETION} AS completion FROM prompts",
    "parse_text_roundtrip": f"""WITH {TEXT} SELECT event_id, t AS timestamp, l AS level, s AS service, m AS message,
        TRY_CAST(nullif(regexp_extract(m, '{DURATION_PATTERN}', 1), '') AS BIGINT) AS duration_ms FROM parsed WHERE reason IS NULL""",
    "parse_reject_counts": f"WITH {TEXT} SELECT coalesce(reason, 'accepted') AS outcome, count(*) AS n FROM parsed GROUP BY 1",
    "parse_json_alias": f"WITH {JSON} SELECT * FROM picked",
    "parse_csv_alias": f"""SELECT event_id, {LEVEL} AS level, 'svc-' || (user_id % 5) AS service, CASE WHEN event_id % 3 = 0 THEN props ELSE event_type END AS message,
        CASE WHEN event_id % 2 = 1 THEN CAST(floor(value) AS BIGINT) END AS duration_ms FROM events WHERE event_id % 8 <> 0""",
    "json_array_items": """SELECT event_id // 500 AS batch, row_number() OVER (PARTITION BY event_id // 500 ORDER BY event_id) - 1 AS idx, event_id,
        event_type AS message, props AS context FROM events""",
    "logfmt_source_logs": f"""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS timestamp, {LEVEL} AS level, 'svc-' || (user_id % 5) AS service,
        props AS message FROM events""",
    "normalize_timestamp": """SELECT event_id, CASE WHEN event_id % 8 IN (0, 1, 2, 4) THEN date_trunc('second', ts) WHEN event_id % 8 = 3 THEN ts
        WHEN event_id % 8 = 5 THEN make_timestamp(epoch_us(ts) // 1000 * 1000) END AS timestamp FROM events""",
    "normalize_level": _levels(),
    "normalize_service": f"""SELECT event_id, nullif(regexp_replace(substr(trim(lower(' API.' || event_type || '@#' || user_id || '_x-' ||
        CASE WHEN event_id % 3 = 0 THEN repeat('Ab', 80) ELSE '' END || ' ')), 1, {MAX_SERVICE}), '[^\\p{{L}}\\p{{N}}\\-_.]', '', 'g'), '') AS service FROM events""",
    "normalize_message_hash": f"SELECT doc_id, length(message) AS length, {HASH} AS message_hash FROM (SELECT doc_id, {_message('text')} AS message FROM documents)",
    "normalize_duration": """SELECT event_id, CASE event_id % 6 WHEN 0 THEN CASE WHEN value > 0 THEN CAST(floor(value) AS BIGINT) END WHEN 1 THEN 0 WHEN 4 THEN 2000 END AS duration_ms FROM events""",
    "normalize_logs_quality": """SELECT count(*) AS total, count(*) FILTER (WHERE NOT bad) AS accepted, count(*) FILTER (WHERE bad) AS skipped
        FROM (SELECT event_id % 11 = 0 OR event_id % 13 = 0 OR event_id % 29 = 0 AS bad FROM events)""",
    "window_align": " UNION ALL ".join(f"SELECT event_id, {n} AS seconds, time_bucket(INTERVAL '{n} seconds', ts, TIMESTAMP '1970-01-01') AS window_start FROM events" for n in (60, 300, 3600, 7000)),
    "price_statistics": "SELECT round(min(x), 2) AS min, round(max(x), 2) AS max, round(avg(x), 2) AS mean, round(median(x), 2) AS median, round(stddev_samp(x), 2) AS stdev FROM (SELECT l_extendedprice AS x FROM lineitem)",
    "documents_message_patterns": f"""SELECT {HASH} AS key, count(*) AS count, min(doc_id) AS first_doc FROM (SELECT doc_id, {_message('text')} AS message FROM documents)
        WHERE message IS NOT NULL GROUP BY 1 HAVING count(*) > 1""",
}
