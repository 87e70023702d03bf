"""Canonical JSON and prompts, byte for byte against the standard library."""

from __future__ import annotations

import datetime as dt
import json
import random
import struct

from pyspark.sql import functions as F

from logsieve.config import IncidentConfig
from logsieve.functions.canonical import canonical_json, json_double, json_text
from logsieve.operators import detect, explain, incidents
from logsieve.schemas import SEVERITIES

from .test_windows_detect import at, make_logs, make_vectors, random_vectors


def test_doubles(spark):
    r = random.Random(6)
    values = [0.0, -0.0, 1.0, -1.5, 1e-4, 9.999e-5, 1e15, 1e16, 123456789012345.6, 0.1 + 0.2, 2e-3, 2.0**-44, 8.41e21, 1e22, 1e100, float("inf"), float("-inf"), float("nan"), 1 / 3]
    values += [r.random() for _ in range(3000)] + [r.uniform(-1, 1) * 10 ** r.randint(-12, 14) for _ in range(3000)]
    values += [v for v in (struct.unpack("d", struct.pack("Q", r.getrandbits(64)))[0] for _ in range(6000)) if 1e-307 < abs(v) < 2**53]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", json_double(F.col("x")).alias("t")).collect()
    assert [(r.x, r.t) for r in rows if r.t != json.dumps(r.x)] == []


def test_texts(spark):
    texts = ["", "plain", 'q " b \\ /', "\n\r\t\b\f\x00\x1f\x7f", "é漢😀 ", "mixed é \" \\ \n", "~ }", "퟿￿"]
    rows = spark.createDataFrame([(v,) for v in texts], "x string").select("x", json_text(F.col("x")).alias("t")).collect()
    assert [r.t for r in rows] == [json.dumps(r.x) for r in rows]


def test_any_type(spark):
    schema = "b int, a struct<z:double,m:map<string,array<bigint>>,t:timestamp_ntz>, c array<struct<y:boolean,x:string>>, n string"
    rows = [
        (1, (0.1, {"é": [1, None], "a": [], "b": None}, dt.datetime(2031, 1, 2, 3, 4, 5)), [(True, "x"), None, (None, None)], None),
        (None, None, None, "x"),
        (2, (None, None, dt.datetime(2031, 1, 2, 3, 4, 5, 60)), [], ""),
    ]
    df = spark.createDataFrame(rows, schema).select(F.struct("*").alias("s"))
    got = [r.t for r in df.select(canonical_json(F.col("s"), df.schema["s"].dataType).alias("t")).collect()]
    want = []
    for row in df.collect():
        d = row.s.asDict(recursive=True)
        if d["a"]:
            d["a"]["m"] = d["a"]["m"] or {}
            d["a"]["t"] = d["a"]["t"].replace(tzinfo=dt.UTC)
        want.append(json.dumps(d, sort_keys=True, default=str))
    assert got == want


def reference_prompt(r) -> str:
    """The prompt of an incident row by the standard library."""
    utc = lambda t: t.replace(tzinfo=dt.UTC)
    names = ("baseline_mean", "baseline_std", "direction", "feature", "observed", "rate_change", "score", "z_score")
    incident = {
        "incident_id": r.incident_id, "service": r.service, "start_time": utc(r.start_time), "end_time": utc(r.end_time),
        "metrics_summary": {"anomaly_count": r.anomaly_count, "feature_count": r.feature_count, "max_score": r.max_score, "severity_counts": r.severity_counts},
        "log_patterns": [p.asDict() for p in r.log_patterns],
        "operational_context": [o.asDict() | {"metadata": o.metadata or {}, "timestamp": utc(o.timestamp)} for o in r.operational_context],
        "anomalies": [
            {
                "event_id": e.event_id, "service": r.service, "score": e.score, "severity": e.severity, "window_start": utc(e.window_start),
                "anomalies": [{n: a[n] for n in names} | {"severity": SEVERITIES[a.severity_rank], "suppressed": False, "suppression_reason": None} for a in e.anomalies],
            }
            for e in r.events
        ],
    }
    lists = "".join(f"\nALLOWED_{n.upper()}: {json.dumps(sorted(r['allowed_' + n]))}" for n in ("causes", "evidence", "steps"))
    return explain.PROMPT_HEAD + explain.INSTRUCTIONS + "\nINCIDENT: " + json.dumps(incident, sort_keys=True, default=str) + lists + "\nRETURN_JSON_ONLY:"


def test_prompts_byte_for_byte(spark):
    events = detect.detect(make_vectors(spark, random_vectors()))
    r = random.Random(2)
    logs = make_logs(spark, [(r.randint(0, 18000), "INFO", f"s{r.randrange(3)}", r.choice(['é "q"', "a\\b", "tab\t", "h1"]), 1, None) for _ in range(900)])
    ops = spark.createDataFrame([("deploy", at(60 * i + 0.25 * (i % 2)), f"roll {i} é", {"sha": "9f", "by": "ci"} if i % 3 else None) for i in range(60)], "event_type string, timestamp timestamp_ntz, description string, metadata map<string,string>")
    found = incidents.build_incidents(events, logs, ops, IncidentConfig())
    rows = explain.with_prompt(explain.with_allowed(found)).collect()
    assert len(rows) > 5 and [x.prompt for x in rows] == [reference_prompt(x) for x in rows]
    assert any(a.rate_change is not None for x in rows for e in x.events for a in e.anomalies)
    pairs = {p.incident_id: p for p in explain.training_pairs(found, explain.explain(found)).collect()}
    explained = {x.incident_id: x.explanation.asDict() for x in explain.explain(found).collect()}
    for x in rows:
        assert pairs[x.incident_id].prompt == x.prompt
        assert pairs[x.incident_id].completion == json.dumps(explained[x.incident_id], sort_keys=True)


def test_instructions_are_canonical():
    assert json.dumps(json.loads(explain.INSTRUCTIONS), sort_keys=True) == explain.INSTRUCTIONS
