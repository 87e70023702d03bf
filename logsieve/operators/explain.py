"""Explanations that may only say what the incident supports.

Allowed causes, evidence and steps are arrays computed from the incident. A model is
any callable from prompts to completions; its answer counts only if it parses,
fits the schema and stays inside the allowed lists. Otherwise, and without a
model, a fixed explanation from known facts is given.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import canonical_json
from ..functions.scoring import severity_name
from ..schemas import EXPLANATION

# What a feature's anomaly may be caused by.
CAUSES = {
    "error_rate_spike": ("error_rate", "error_count"),
    "warning_spike": ("warning_rate", "warning_count"),
    "latency_regression": ("median_duration_ms", "p95_duration_ms", "max_duration_ms"),
    "traffic_spike": ("total_events", "info_count"),
    "error_variation": ("unique_messages", "unique_error_codes"),
}
# The step that follows from any of these causes.
STEPS = (
    (("deployment_change",), "Review recent deployments in the incident window"),
    (("error_rate_spike", "warning_spike"), "Inspect error and warning logs for the affected service"),
    (("latency_regression",), "Check latency metrics and downstream dependencies"),
    (("traffic_spike",), "Verify traffic sources and request patterns"),
    (("error_variation",), "Group errors by code to identify new patterns"),
)
# Texts of the contract.
ALWAYS_STEP = "Validate incident scope and confirm if impact persists"
FALLBACK_SUMMARY = "Incident explanation unavailable; fallback generated from known facts."
FALLBACK_LIMITS = "LLM output was invalid or unavailable; returned minimal factual summary."
FALLBACK_CONFIDENCE = 0.1
INSTRUCTIONS = (
    '{"constraints": ["Return a single JSON object only.", "Do NOT include any text outside JSON.", '
    '"Use only allowed values for probable_causes, supporting_evidence, and recommended_next_steps.", '
    '"Do NOT invent facts beyond the incident data.", "If uncertain, state limitations clearly."], '
    '"schema": {"confidence_score": "float in [0,1]", "incident_id": "string", "limitations": "string", '
    '"probable_causes": "list[string]", "recommended_next_steps": "list[string]", "summary": "string", '
    '"supporting_evidence": "list[string]"}, "task": "Explain the incident using only provided facts."}'
)
PROMPT_HEAD = "You are a reliability assistant. Use ONLY the incident data and allowed lists.\nINSTRUCTIONS: "

Model = Callable[[list[str]], list[str]]


def iso(c: Column) -> Column:
    """ISO text in UTC; a fraction only if there is one."""
    whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(c, "SSSSSS")
    return F.concat(whole, F.when(fraction == "000000", "").otherwise(F.concat(F.lit("."), fraction)), F.lit("+00:00"))


def _features_of(events: Column) -> Column:
    return F.flatten(F.transform(events, lambda e: F.transform(e["anomalies"], lambda a: a["feature"])))


def _if(condition: Column, value: str) -> Column:
    return F.when(condition, F.array(F.lit(value))).otherwise(F.array().cast("array<string>"))


def _sorted_set(*parts: Column) -> Column:
    return F.array_sort(F.array_distinct(F.concat(*parts)))


def with_allowed(incidents: DataFrame) -> DataFrame:
    """Adds allowed_causes, allowed_evidence and allowed_steps, each sorted and distinct."""
    df = incidents.withColumn("__features", _features_of(F.col("events")))
    hit = lambda names: F.arrays_overlap("__features", F.array(*map(F.lit, names)))
    deployed = F.exists("operational_context", lambda o: F.lower(o["event_type"]).contains("deploy"))
    causes = [_if(hit(names), cause) for cause, names in CAUSES.items()]
    df = df.withColumn("allowed_causes", _sorted_set(F.array(F.lit("unknown")), *causes, _if(deployed, "deployment_change")))
    has = lambda names: F.arrays_overlap("allowed_causes", F.array(*map(F.lit, names)))
    steps = [_if(has(names), step) for names, step in STEPS]
    df = df.withColumn("allowed_steps", _sorted_set(F.array(F.lit(ALWAYS_STEP)), *steps))
    tag = lambda name, c: F.concat(F.lit(f"{name}="), c)
    each = lambda f: F.transform("events", f)
    nested = lambda name: F.flatten(each(lambda e: F.transform(e["anomalies"], lambda a: tag(name, a[name]))))
    evidence = _sorted_set(
        F.array(
            tag("service", F.col("service")),
            tag("start_time", iso(F.col("start_time"))),
            tag("end_time", iso(F.col("end_time"))),
            tag("max_score", F.format_string("%.2f", F.col("max_score"))),
        ),
        each(lambda e: tag("window_start", iso(e["window_start"]))),
        each(lambda e: tag("severity", e["severity"])),
        nested("feature"),
        nested("direction"),
        F.transform("log_patterns", lambda p: F.concat(tag("log_pattern", p["key"]), F.lit("|count="), p["count"].cast("string"))),
        F.transform("operational_context", lambda o: F.concat(tag("op_event", o["event_type"]), F.lit("|time="), iso(o["timestamp"]))),
    )
    return df.withColumn("allowed_evidence", evidence).drop("__features")


def incident_payload() -> Column:
    """The whole incident as a struct: every field of its events and anomalies but the time of detection, which isn't a fact of the logs."""
    anomaly = lambda a: F.struct(
        *(a[n].alias(n) for n in ("baseline_mean", "baseline_std", "direction", "feature", "observed", "rate_change", "score", "z_score")),
        severity_name(a["severity_rank"]).alias("severity"),
        F.lit(False).alias("suppressed"),  # events hold no others
        F.lit(None).cast("string").alias("suppression_reason"),
    )
    event = lambda e: F.struct(
        F.transform(e["anomalies"], anomaly).alias("anomalies"),
        F.col("service").alias("service"),
        *(e[n].alias(n) for n in ("event_id", "score", "severity", "window_start")),
    )
    operation = lambda o: F.struct(*(o[n].alias(n) for n in ("description", "event_type", "metadata", "timestamp")))
    return F.struct(
        F.transform("events", event).alias("anomalies"),
        "end_time", "incident_id", "log_patterns",
        F.struct("anomaly_count", "feature_count", "max_score", "severity_counts").alias("metrics_summary"),
        F.transform("operational_context", operation).alias("operational_context"),
        "service", "start_time",
    )


def with_prompt(allowed: DataFrame) -> DataFrame:
    """Adds prompt: instructions, the incident as canonical JSON, and the allowed lists."""
    df = allowed.withColumn("__incident", incident_payload())
    text = lambda name: canonical_json(F.col(name), df.schema[name].dataType)
    prompt = F.concat(
        F.lit(PROMPT_HEAD + INSTRUCTIONS + "\nINCIDENT: "), text("__incident"),
        F.lit("\nALLOWED_CAUSES: "), text("allowed_causes"),
        F.lit("\nALLOWED_EVIDENCE: "), text("allowed_evidence"),
        F.lit("\nALLOWED_STEPS: "), text("allowed_steps"),
        F.lit("\nRETURN_JSON_ONLY:"),
    )
    return df.withColumn("prompt", prompt).drop("__incident")


def fallback() -> Column:
    """The explanation from known facts alone."""
    return F.struct(
        F.col("incident_id"),
        F.lit(FALLBACK_SUMMARY).alias("summary"),
        F.array(F.lit("unknown")).alias("probable_causes"),
        F.slice("allowed_evidence", 1, 3).alias("supporting_evidence"),
        F.lit(FALLBACK_CONFIDENCE).alias("confidence_score"),
        F.array(F.lit(ALWAYS_STEP)).alias("recommended_next_steps"),
        F.lit(FALLBACK_LIMITS).alias("limitations"),
    )


def parse_completion(completion: Column) -> Column:
    """The object between the first '{' and the last '}'; null if there is none or it doesn't parse."""
    body = F.regexp_extract(completion, r"(?s)(\{.*\})", 1)
    return F.when(body != "", F.from_json(body, EXPLANATION, {"mode": "PERMISSIVE"}))


def valid(x: Column) -> Column:
    """Bounds of every field, and only allowed values."""
    inside = lambda c, low, high: F.coalesce(F.size(c).between(low, high), F.lit(False))
    text = lambda c: F.coalesce(F.char_length(c).between(10, 500), F.lit(False))
    subset = lambda c, allowed: F.size(F.array_except(c, F.col(allowed))) == 0
    return (
        x["incident_id"].isNotNull()
        & text(x["summary"])
        & text(x["limitations"])
        & inside(x["probable_causes"], 1, 5)
        & inside(x["supporting_evidence"], 1, 10)
        & inside(x["recommended_next_steps"], 1, 5)
        & F.coalesce(x["confidence_score"].between(0, 1), F.lit(False))
        & subset(x["probable_causes"], "allowed_causes")
        & subset(x["supporting_evidence"], "allowed_evidence")
        & subset(x["recommended_next_steps"], "allowed_steps")
    )


def with_completion(prompted: DataFrame, model: Model) -> DataFrame:
    """Adds completion by a model; a failing batch has null completions."""

    @F.pandas_udf("string")
    def complete(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for prompts in batches:
            try:
                yield pd.Series(model(list(prompts)), dtype=object)
            except Exception:  # noqa: BLE001 - any failure of the model means the fallback
                yield pd.Series([None] * len(prompts), dtype=object)

    return prompted.withColumn("completion", complete("prompt"))


def explain(incidents: DataFrame, model: Model | None = None) -> DataFrame:
    """incident_id, service and explanation of every incident."""
    df = with_allowed(incidents)
    if model is None:
        return df.select("incident_id", "service", fallback().alias("explanation"))
    df = with_completion(with_prompt(df), model).withColumn("answer", parse_completion(F.col("completion")))
    good = F.coalesce(valid(F.col("answer")), F.lit(False))
    return df.select("incident_id", "service", F.when(good, F.col("answer")).otherwise(fallback()).alias("explanation"))


def explanation_rows(explained: DataFrame) -> DataFrame:
    """What a user interface shows."""
    e = F.col("explanation")
    return explained.select(
        "incident_id",
        e["summary"].alias("what_happened"),
        F.coalesce(F.get(e["probable_causes"], 0), F.lit("unknown")).alias("likely_cause"),
        e["confidence_score"].alias("confidence"),
        e["recommended_next_steps"].alias("suggested_actions"),
        F.array("service").alias("affected_services"),
    )


def training_pairs(incidents: DataFrame, explanations: DataFrame) -> DataFrame:
    """incident_id, prompt and completion (canonical JSON), to tune a model."""
    prompted = with_prompt(with_allowed(incidents)).select("incident_id", "prompt")
    completion = canonical_json(F.col("explanation"), explanations.schema["explanation"].dataType)
    return prompted.join(explanations.select("incident_id", completion.alias("completion")), "incident_id")
