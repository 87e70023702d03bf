"""Windows, features, baselines, detection, incidents, explanations."""

from __future__ import annotations

import datetime as dt
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from logsieve.config import BaselineConfig, DetectionConfig, IncidentConfig
from logsieve.operators import baselines, detect, explain, features, incidents, stats, windows
from logsieve.schemas import CANONICAL, FAMILIES, FEATURE_VECTOR, FEATURES
from logsieve.streaming.state import ServiceState

T0 = dt.datetime(2025, 2, 7, 10, 30)


def at(seconds: float) -> dt.datetime:
    return T0 + dt.timedelta(seconds=seconds)


def make_logs(spark, rows):
    """rows: (seconds, level, service, message hash, duration, error code)."""
    full = [(at(s), lv, sv, h, h, d, e, f"r{i}") for i, (s, lv, sv, h, d, e) in enumerate(rows)]
    return spark.createDataFrame(full, CANONICAL)


def vector(service: str, seconds: float, **values) -> tuple:
    base = dict.fromkeys(FEATURES, None) | {"total_events": 100, "error_count": 1, "warning_count": 1, "info_count": 98, "error_rate": 0.01, "warning_rate": 0.01, "unique_messages": 5, "unique_error_codes": 0}
    row = base | values
    return (service, at(seconds), *(row[f] for f in FEATURES))


def make_vectors(spark, rows):
    return spark.createDataFrame(rows, FEATURE_VECTOR)


def test_alignment(spark):
    rows = spark.createDataFrame([(dt.datetime(2025, 2, 7, 10, 32, 30), 300, dt.datetime(2025, 2, 7, 10, 30)), (dt.datetime(2025, 2, 7, 10, 45, 30), 3600, dt.datetime(2025, 2, 7, 10))], "t timestamp_ntz, n int, w timestamp_ntz")
    for n in (300, 3600):
        assert rows.where(F.col("n") == n).where(windows.window_start(F.col("t"), n) == F.col("w")).count() == 1
    with pytest.raises(ValueError):
        windows.window_start(F.col("t"), 0)


def test_window_operators(spark):
    logs = make_logs(spark, [(0, "INFO", "a", "h", 1, None), (10, "INFO", "b", "h", 1, None), (301, "INFO", "a", "h", 1, None), (5, "INFO", "a", "h2", 1, None)])
    w = windows.log_counts(logs)
    assert {(r.service, r.window_start, r.log_count) for r in w.collect()} == {("a", at(0), 2), ("b", at(0), 1), ("a", at(300), 1)}
    assert windows.time_range(w).first() == (at(0), at(600))
    assert windows.time_range(w.where("false")).first() == (None, None)
    assert windows.filter_service(w, "a").count() == 2
    assert windows.filter_time(w, str(at(0)), str(at(300))).count() == 2
    assert [(r.window_start, r.service) for r in windows.in_order(w).collect()] == [(at(0), "a"), (at(0), "b"), (at(300), "a")]
    assert windows.render_summary(windows.windows_summary(w)).splitlines()[0] == "Windows: 3, logs: 4"
    nested = {(r.service, r.window_start): [x.timestamp for x in r.logs] for r in windows.nested_windows(logs).collect()}
    assert nested["a", at(0)] == [at(0), at(5)]


def test_features(spark):
    rows = [(i, lv, "s", f"h{i % 3}", d, e) for i, (lv, d, e) in enumerate([("INFO", 100, None), ("INFO", 200, "E1"), ("WARNING", 500, "E1"), ("ERROR", 800, "E2"), ("CRITICAL", None, ""), ("DEBUG", None, None)])]
    r = features.window_features(make_logs(spark, rows)).first()
    assert (r.total_events, r.error_count, r.warning_count, r.info_count) == (6, 2, 1, 2)
    assert (r.error_rate, r.warning_rate) == (2 / 6, 1 / 6)
    assert (r.median_duration_ms, r.p95_duration_ms, r.max_duration_ms) == (350.0, 800.0, 800.0)
    assert (r.unique_messages, r.unique_error_codes) == (3, 2)


def test_features_equal_those_of_families(spark):
    """Counted values and direct aggregations agree on ties, nulls and mixed levels."""
    levels = ("INFO", "ERROR", "CRITICAL", "WARNING", "DEBUG")
    rows = [(i % 7 * 100, levels[i % 5], "ab"[i % 2], f"h{i % 4}" if i % 6 else "", i % 9 or None, f"E{i % 3}" if i % 5 == 1 else None) for i in range(90)]
    logs = make_logs(spark, rows)
    got = features.window_features(logs).collect()
    want = features.window_features(logs, 300, features.all_features()).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert len(got) > 2


@pytest.mark.parametrize("n", [1, 2, 19, 20, 21, 39, 40, 100, 101])
def test_p95_index(spark, n):
    values = random.Random(n).sample(range(1, 10_000), n)
    r = features.window_features(make_logs(spark, [(0, "INFO", "s", "h", v, None) for v in values])).first()
    assert r.p95_duration_ms == sorted(values)[min(int(0.95 * n), n - 1)]


def test_statistics(spark):
    df = spark.createDataFrame([(0.05,), (0.20,), (None,)], "x double")
    r = stats.statistics(df, "x").first()
    assert (r.min, r.max, r.mean) == (0.05, 0.20, 0.125) and math.isclose(r.stdev, 0.10606601717798213)
    assert stats.statistics(df.where("x < 0.1"), "x").first().stdev == 0.0
    assert [x.x for x in stats.above_baseline(df, "x", stats.statistics(df, "x"), 1.5).collect()] == [0.2]
    with pytest.raises(Exception, match="no values"):
        stats.statistics(df.where("false"), "x").collect()


def test_median_of_statistics_is_selected_from_counts(spark):
    """Exact for signs, ties, tiny, huge and infinite values, and no task gets all values."""
    r = random.Random(3)
    some = [r.choice([-1, 1]) * 10.0 ** r.uniform(-320, 300) for _ in range(301)]
    for values in ([2.0], [1.0, 2.0], [-3.0, -1.0, 0.0, -0.0], [5.0] * 9 + [7.0], some, some[:300], [float("-inf"), 1.0, 4.0, float("inf")], [1.0, float("nan"), float("nan")]):
        df = spark.createDataFrame([(v,) for v in [*values, None]], "x double")
        got, want = stats.statistics(df, "x").first().median, df.agg(F.median("x")).first()[0]
        assert got == want or (math.isnan(got) and math.isnan(want)), values
    rows = stats.statistics(spark.range(4000).selectExpr("id * 0.37 AS x"), "x")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan and "median(" not in plan and "collect_" not in plan
    assert rows.first().median == (1999 * 0.37 + 2000 * 0.37) / 2


def long_rows(spark, values):
    rows = [("s", at(300 * i), "error_rate", float(v), 4) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "service string, window_start timestamp_ntz, feature string, observed double, ordinal int")


def test_rolling_and_ewma(spark):
    got = baselines.with_baselines(long_rows(spark, [1, 2, 3, 4, 9]), BaselineConfig(window_size=4, min_points=3, strategy="rolling"))
    rows = got.orderBy("window_start").collect()
    assert [r.baseline and r.baseline.mean for r in rows] == [None, None, None, 2.0, 2.5]
    assert math.isclose(rows[4].baseline.std, math.sqrt(1.25)) and rows[4].previous == 4.0
    got = baselines.with_baselines(long_rows(spark, [10, 20, 30, 5]), BaselineConfig(min_points=3, ewma_alpha=0.5, strategy="ewma"))
    last = got.orderBy(F.desc("window_start")).first().baseline
    assert math.isclose(last.mean, 22.5) and math.isclose(last.std, math.sqrt(34.375)) and last["count"] == 3


@pytest.mark.parametrize("alpha", [0.001, 0.05, 0.2, 0.5, 0.9, 0.999, 1 - 1e-12])
@pytest.mark.parametrize("level", [0.0, 1e6])
def test_ewma_equals_the_recursion(spark, alpha, level):
    """To 1e-12 over many blocks, whatever the weight; a far level doesn't cost digits of the variance."""
    r = random.Random(5)
    values = [level + r.gauss(0, 3) + (500 if i % 997 == 0 else 0) for i in range(4000)]
    rows = baselines.with_baselines(long_rows(spark, values), BaselineConfig(min_points=3, ewma_alpha=alpha, strategy="ewma", std_floor=1e-9))
    got = [x.baseline for x in rows.orderBy("window_start").collect()]
    m, v = values[0], 0.0
    for i, x in enumerate(values):
        if i:
            if i >= 3:
                assert math.isclose(got[i].mean, m, rel_tol=1e-12, abs_tol=1e-12)
                # The recursion itself loses digits where the level is far from zero.
                assert math.isclose(got[i].std, max(math.sqrt(v), 1e-9), rel_tol=1e-12 if level == 0 and alpha < 0.99 else 1e-7, abs_tol=1e-12)
            before = m
            m = alpha * x + (1 - alpha) * m
            v = alpha * ((1 - alpha) * (x - before)) ** 2 + (1 - alpha) * v
    assert got[2] is None and got[3]["count"] == 3
    assert "collect_list" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_warm_up_and_spike(spark):
    rows = [vector("s", 300 * i) for i in range(10)]
    assert detect.detect(make_vectors(spark, rows)).count() == 0
    spike = vector("s", 3000, error_rate=0.5, error_count=50)
    event = detect.detect(make_vectors(spark, [*rows, spike])).first()
    assert event.severity == "critical" and event.score == 1.0 and "error_rate" in [a.feature for a in event.anomalies]


def test_suppression_tie_keeps_first_feature(spark):
    rows = [vector("s", 300 * i) for i in range(10)] + [vector("s", 3000, error_rate=0.6, warning_rate=0.5)]
    got = detect.suppress(detect.feature_anomalies(make_vectors(spark, rows))).where("family = 'rate'").orderBy("ordinal").collect()
    assert [(r.feature, r.suppressed, r.suppression_reason) for r in got] == [("error_rate", False, None), ("warning_rate", True, "suppressed_by_rate_family")]
    off = detect.suppress(detect.feature_anomalies(make_vectors(spark, rows)), enabled=False)
    assert off.where("suppressed").count() == 0


def random_vectors(n_services=3, n=60, seed=4):
    r = random.Random(seed)
    rows = []
    for s in range(n_services):
        for i in range(n):
            calm = r.random() < 0.85
            rows.append(vector(f"s{s}", 300 * i, total_events=r.randint(90, 110) if calm else r.randint(200, 900), error_count=r.randint(0, 3) if calm else 60, error_rate=r.random() / 50 if calm else 0.5, median_duration_ms=None if r.random() < 0.2 else r.random() * 100, p95_duration_ms=200.0 + r.random(), max_duration_ms=300.0 + r.random() * (1 if calm else 500)))
    return rows


@pytest.mark.parametrize("strategy", ["rolling", "ewma", "hybrid"])
def test_plan_equals_scan(spark, strategy):
    config = DetectionConfig(baseline=BaselineConfig(strategy=strategy))
    rows = random_vectors()
    got = detect.suppress(detect.feature_anomalies(make_vectors(spark, rows), config))
    got = {(r.service, r.window_start, r.feature): (round(r.score, 9), r.severity_rank, r.direction, r.suppressed) for r in got.collect()}
    want = {}
    for service in sorted({r[0] for r in rows}):
        state = ServiceState(config)
        for row in rows:
            if row[0] == service:
                for a in state.update(dict(zip(FEATURES, row[2:], strict=True))):
                    want[service, row[1], a["feature"]] = (round(a["score"], 9), a["severity_rank"], a["direction"], a["suppressed"])
        assert ServiceState.of(state.rows(), config).rows() == state.rows()
    assert got == want and len(got) > 20


def make_events(spark, rows):
    """rows: (service, seconds, feature)."""
    family_rows = [(s, at(t), f, FEATURES.index(f)) for s, t, f in rows]
    df = spark.createDataFrame(family_rows, "service string, window_start timestamp_ntz, feature string, ordinal int")
    df = df.withColumns({"observed": F.lit(1.0), "baseline": F.struct(F.lit(0.0).alias("mean"), F.lit(1.0).alias("std")), "z_score": F.lit(8.0), "rate_change": F.lit(1.0), "score": F.lit(0.9), "severity_rank": F.lit(4), "direction": F.lit("high"), "suppressed": F.lit(False)})
    return detect.anomaly_events(df)


def starts(df):
    return sorted((r.service, r.start_time, r.anomaly_count) for r in df.collect())


def test_incident_gap(spark):
    ev = make_events(spark, [("s", 0, "error_rate"), ("s", 120, "error_rate"), ("s", 720, "error_rate")])
    loose = IncidentConfig(max_gap_seconds=60, require_feature_family_overlap=False)
    assert len(starts(incidents.build_incidents(ev, config=loose))) == 3
    assert starts(incidents.build_incidents(ev, config=IncidentConfig(require_feature_family_overlap=False))) == [("s", at(0), 3)]


def test_incident_overlap(spark):
    ev = make_events(spark, [("s", 0, "error_rate"), ("s", 120, "max_duration_ms")])
    assert len(starts(incidents.build_incidents(ev))) == 2
    r, d = "error_rate", "max_duration_ms"
    rows = [("s", 0, r), ("s", 300, d), ("s", 600, r), ("s", 600, d), ("s", 1200, d), ("s", 1801, d), ("t", 1801, d)]
    assert starts(incidents.build_incidents(make_events(spark, rows))) == [("s", at(0), 1), ("s", at(300), 3), ("s", at(1801), 1), ("t", at(1801), 1)]
    merged = incidents.build_incidents(make_events(spark, [("s", 0, r), ("t", 0, r)]), config=IncidentConfig(merge_across_services=True))
    assert merged.count() == 1


def test_incident_overlap_in_long_sessions(spark):
    """One pass over sorted rows, across batches and services, equals a plain scan."""
    r = random.Random(31)
    rows = [(s, 300 * i, r.choice(FEATURES)) for s in "abc" for i in range(700)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    got = incidents.assign_incidents(make_events(spark, rows)).groupBy("owner", "session", "part").agg(F.min("window_start").alias("t"), F.count(F.lit(1)).alias("n"))
    got = sorted((x.owner, x.t, x.n) for x in got.collect())
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for s in "abc":
        seen: set = set()
        for _, t, f in (x for x in rows if x[0] == s):
            name = detect_family(f)
            if name not in seen:
                want.append([s, at(t), 0])
                seen = set()
            seen.add(name)
            want[-1][2] += 1
    assert got == sorted(map(tuple, want))


def detect_family(feature):
    return next(name for name, group in FAMILIES.items() if feature in group)


def test_log_patterns_count_inner_slots(spark):
    ev = make_events(spark, [("s", 300 * i, "error_rate") for i in range(5)])
    found = incidents.incident_metrics(incidents.assign_incidents(ev))
    r = random.Random(32)
    logs = make_logs(spark, [(r.randint(-700, 2500), "INFO", r.choice("st"), f"h{r.choice([1, 1, 1, 2, 2, 3, 4])}", 1, None) for _ in range(4000)])
    inside = [x for x in logs.collect() if x.service == "s" and at(-300) <= x.timestamp <= at(1800)]
    for slot, most in ((60, 0), (300, 0), (7000, 0), (60, 10**6), (300, 10**6), (7000, 10**6)):
        got = {x.key: x["count"] for x in incidents.log_patterns(found, logs, slot_seconds=slot, most_slots=most).collect()}
        assert got == {h: sum(x.message_hash == h for x in inside) for h in ("h1", "h2", "h3", "h4")}


def test_log_patterns_shuffle_what_incidents_touch(spark):
    """The semi-join stands below the aggregation, and what is shuffled falls with the incidents."""
    logs = make_logs(spark, [(300 * i + j, "INFO", s, f"h{j % 20}", 1, None) for i in range(200) for j in range(40) for s in "st"])
    written = []
    for n in (1, 50):
        found = incidents.incident_metrics(incidents.assign_incidents(make_events(spark, [("s", 300 * i, "error_rate") for i in range(n)])))
        rows = incidents.log_patterns(found, logs)
        rows.collect()
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("Aggregate [service") < plan.index("Join LeftSemi, ")
        counted = rows._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin [service" in counted and "LeftSemi, BuildRight" in counted
        keys = rows.groupBy("incident_id").count().count()
        written.append((keys, sum(r["count"] for r in rows.collect())))
    assert written[0][1] < written[1][1] / 10


def test_a_window_of_a_million_durations(spark):
    """Exact order statistics, with no array in the plan."""
    values = spark.range(1_000_000).select((F.pmod(F.col("id") * 7919, F.lit(1_000_003)) * 1_000_003 + 5).alias("duration_ms"))
    logs = values.select(
        F.lit(at(0)).cast("timestamp_ntz").alias("timestamp"), F.lit("INFO").alias("level"), F.lit("s").alias("service"), F.lit("m").alias("message"),
        F.lit("h").alias("message_hash"), "duration_ms", F.lit(None).cast("string").alias("error_code"), F.lit(None).cast("string").alias("request_id"),
    )
    rows = features.window_features(logs)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "percentile" not in plan
    r = rows.first()
    want = sorted(i * 7919 % 1_000_003 * 1_000_003 + 5 for i in range(1_000_000))
    assert (r.median_duration_ms, r.p95_duration_ms) == ((want[499_999] + want[500_000]) / 2, want[950_000])
    assert (r.max_duration_ms, r.total_events) == (want[-1], 1_000_000)


@pytest.mark.parametrize("value", [0, 1, 4095, 4096, 4097, 2**31 - 1, 2**31, 2**53 + 1, 2**62, 2**63 - 1, -1, -4097])
def test_buckets_keep_the_order(spark, value):
    near = sorted({max(-(2**63), min(2**63 - 1, value + d)) for d in (-3, -1, 0, 1, 3)})
    got = [r.b for r in spark.createDataFrame([(v,) for v in near], "v bigint").select("v", features.bucket_of(F.col("v")).alias("b")).orderBy("v").collect()]
    assert got == sorted(got) and all(b <= v for b, v in zip(got, near, strict=True))


def test_incident_context(spark):
    ev = make_events(spark, [("s", 600, "error_rate")])
    logs = make_logs(spark, [(300, "INFO", "s", "in", 1, None), (1200, "INFO", "s", "in", 1, None), (299, "INFO", "s", "out", 1, None), (1201, "INFO", "s", "out", 1, None), (600, "INFO", "t", "other", 1, None), (700, "INFO", "s", "b", 1, None)])
    ops = spark.createDataFrame([("deployment", at(630), "late"), ("Deployment", at(570), "early"), ("x", at(5000), "far")], "event_type string, timestamp timestamp_ntz, description string")
    got = incidents.build_incidents(ev, logs, ops, IncidentConfig(max_operational_events=1)).first()
    assert [(p.key, p["count"]) for p in got.log_patterns] == [("in", 2), ("b", 1)]
    assert [o.description for o in got.operational_context] == ["early"]
    assert got.severity_counts == {"critical": 1} and got.feature_count == 1 and got.end_time == at(900)
    bare = incidents.build_incidents(ev).first()
    assert bare.log_patterns == [] and bare.operational_context == []


def test_explanations(spark):
    ev = make_events(spark, [("s", 600, "error_rate"), ("s", 600, "max_duration_ms")])
    ops = spark.createDataFrame([("Deploy", at(630), "d")], "event_type string, timestamp timestamp_ntz, description string")
    found = incidents.build_incidents(ev, None, ops)
    row = explain.with_allowed(found).first()
    assert row.allowed_causes == ["deployment_change", "error_rate_spike", "latency_regression", "unknown"]
    assert "op_event=Deploy|time=2025-02-07T10:40:30+00:00" in row.allowed_evidence and len(row.allowed_steps) == 4
    prompt = explain.with_prompt(explain.with_allowed(found)).first().prompt
    assert prompt.endswith("RETURN_JSON_ONLY:") and json.loads(prompt.split("INCIDENT: ")[1].split("\n")[0])["service"] == "s"
    for answer in ("not json", '{"summary": "x"}', json.dumps({"incident_id": row.incident_id, "summary": "long enough text", "probable_causes": ["made_up"], "supporting_evidence": ["service=s"], "confidence_score": 0.5, "recommended_next_steps": row.allowed_steps[:1], "limitations": "none that are known"})):
        got = explain.explain(found, lambda prompts, a=answer: [a] * len(prompts)).first().explanation
        assert got.probable_causes == ["unknown"] and got.confidence_score == 0.1
    good = json.dumps({"incident_id": row.incident_id, "summary": "long enough text", "probable_causes": ["unknown"], "supporting_evidence": ["service=s"], "confidence_score": 0.5, "recommended_next_steps": row.allowed_steps[:1], "limitations": "none that are known"})
    got = explain.explain(found, lambda prompts: [f"Sure: {good} done"] * len(prompts)).first().explanation
    assert got.confidence_score == 0.5 and got.summary == "long enough text"

    def broken(prompts):
        raise RuntimeError

    assert explain.explain(found, broken).first().explanation.confidence_score == 0.1
    pair = explain.training_pairs(found, explain.explain(found)).first()
    assert json.loads(pair.completion)["incident_id"] == row.incident_id
    noted = incidents.build_incidents(ev, None, ops.withColumn("metadata", F.create_map(F.lit("sha"), F.lit("9f"), F.lit("by"), F.lit("ci"))))
    prompt = explain.with_prompt(explain.with_allowed(noted)).first().prompt
    assert '"event_type": "Deploy", "metadata": {"by": "ci", "sha": "9f"}, "timestamp": "2025-02-07 10:40:30+00:00"' in prompt
