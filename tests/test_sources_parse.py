"""Sources and parsers on the documented contract."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from logsieve.operators import normalize, parse
from logsieve.plans import Engine, canonical_logs
from logsieve.sources import LogIngestionError, detect_format, read_logs
from logsieve.sources.logs import read_json_logs, read_text_logs


def texts(spark, *lines):
    return parse.parse_text(spark.createDataFrame([(x,) for x in lines], "value string"))


def test_text_line(spark):
    row = texts(spark, "2031-06-19T23:04:51Z CRITICAL ledger-7 Replica lost quorum (730ms)").first()
    assert (row.level, row.service, row.duration_ms, row.timestamp) == ("CRITICAL", "ledger-7", 730, "2031-06-19T23:04:51Z")
    assert row.message == "Replica lost quorum (730ms)" and row.reject_reason is None


@pytest.mark.parametrize(
    ("line", "expected"),
    [
        ("2031-06-19T23:04:51Z warning mailer queue grows", ("WARNING", "mailer", "queue grows", None)),
        ("2031-06-19T23:04:51.123Z INFO mailer sent (5s)", ("INFO", "mailer", "sent (5s)", 5)),
        ("2031-06-19T23:04:51Z [pool-3] INFO mailer.smtp x", ("INFO", "mailer", ".smtp x", None)),
        ("2031-06-19T23:04:51Z INFO mailer", ("INFO", "mailer", "[No message] 2031-06-19T23:04:51Z INFO mailer", None)),
    ],
)
def test_text_variants(spark, line, expected):
    row = texts(spark, line).first()
    assert row.reject_reason is None and (row.level, row.service, row.message, row.duration_ms) == expected


def test_text_rejects(spark):
    rows = texts(spark, "garbage", "", "2031-06-19T23:05:02Z nothing here", "2031-06-19T23:05:02Z INFO !!")
    assert [r.reject_reason for r in rows.collect()] == ["no timestamp", "empty line", "no level", "no service"]
    assert parse.quality_report(rows).first().asDict() == {"total": 4, "accepted": 0, "skipped": 4}


def fields(spark, *maps):
    return spark.createDataFrame([(m,) for m in maps], "fields map<string,string>")


def test_json_aliases_and_nulls(spark):
    rows = parse.parse_json(
        fields(
            spark,
            {"ts": "2031-06-19T23:05:09Z", "level_name": "info", "app": "a", "msg": "m", "duration": "730"},
            {"timestamp": "x", "level": None, "service": None, "message": None, "duration_ms": "bad", "duration": "7"},
            {"timestamp": None, "time": "t", "message": "m"},
            {"timestamp": "t"},
        )
    ).collect()
    assert (rows[0].level, rows[0].service, rows[0].message, rows[0].duration_ms) == ("INFO", "a", "m", 730)
    assert (rows[1].level, rows[1].service, rows[1].message, rows[1].duration_ms) == ("NONE", "None", "None", None)
    assert rows[2].reject_reason == "no timestamp" and rows[3].reject_reason == "no message"


def test_csv_first_filled_wins(spark):
    row = parse.parse_csv(fields(spark, {"timestamp": "", "time": "t", "message": "", "msg": "m", "duration": "41"})).first()
    assert (row.timestamp, row.message, row.duration_ms) == ("t", "m", 41)


def test_files(spark, tmp_path):
    text = tmp_path / "a.log"
    text.write_text("﻿2031-06-19T23:07:00Z INFO mailer queue drained (12ms)\n\n  garbage \n2031-06-19T23:07:41Z ERROR ledger-7 quorum lost (873ms)\n")
    assert read_logs(spark, str(text)).count() == 3
    numbered = read_text_logs(spark, str(text), line_numbers=True).orderBy("source_meta.line_number").collect()
    assert [r.source_meta.line_number for r in numbered] == [1, 3, 4]
    assert canonical_logs(read_logs(spark, str(text))).count() == 2
    array = tmp_path / "a.json"
    array.write_text(json.dumps([{"timestamp": "2031-06-19T23:07:00Z", "level": "INFO", "service": "s", "message": "m"}, 3, "x"]))
    assert read_logs(spark, str(array)).count() == 1
    lines = tmp_path / "b.json"
    lines.write_text('{"ts": 1951689547, "msg": "m", "app": "s", "level": "error"}\nnot json\n[1]\n{"a": 1}\n')
    assert read_logs(spark, str(lines)).count() == 2
    assert canonical_logs(read_json_logs(spark, str(lines), line_numbers=True)).first().level == "ERROR"
    csv = tmp_path / "a.csv"
    csv.write_text('﻿timestamp,level,service,message,duration_ms\n2031-06-19T23:07:00Z,INFO,ledger-7,"a ""b"", c",25\n,,,,\n')
    rows = canonical_logs(read_logs(spark, str(csv))).collect()
    assert len(rows) == 1 and rows[0].message == 'a "b", c' and rows[0].duration_ms == 25


def test_mixed_json_folder(spark, tmp_path):
    folder = tmp_path / "mixed"
    folder.mkdir()
    (folder / "a.json").write_text('\n [{"ts": "2031-01-05T08:00:00Z", "msg": "one", "app": "s"}, 4]')
    (folder / "b.json").write_text('{"ts": "2031-01-05T08:01:00Z", "msg": "two", "app": "s"}\noops\n\n{"ts": "2031-01-05T08:02:00Z", "msg": "three", "app": "s"}\n')
    (folder / "c.json").write_text("")
    rows = read_json_logs(spark, str(folder), line_numbers=True).collect()
    assert sorted((r.fields["msg"], r.source_meta.line_number, r.source_meta.idx, r.source_meta.format) for r in rows) == [
        ("one", None, 0, "json_array"), ("three", 4, None, "ndjson"), ("two", 1, None, "ndjson"),
    ]
    kept = parse.parse_logs(read_json_logs(spark, str(folder), keep_malformed=True))
    assert parse.quality_report(kept).first().asDict() == {"total": 4, "accepted": 3, "skipped": 1}
    assert kept.where("reject_reason = 'malformed JSON'").count() == 1
    assert read_json_logs(spark, str(folder / "b.json"), shape="lines").count() == 2
    assert read_json_logs(spark, str(folder / "a.json"), shape="array").count() == 1


def test_line_numbers_across_blocks(spark, tmp_path):
    for name, n in (("a", 3000), ("b", 700)):
        (tmp_path / f"{name}.log").write_text("".join("\n" if i % 10 == 9 else f"line {name}{i + 1}\n" for i in range(n)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        raw = read_text_logs(spark, str(tmp_path), line_numbers=True)
        assert raw.rdd.getNumPartitions() > 4 or raw.count() == 3330
        assert all(r.value[6:] == str(r.source_meta.line_number) for r in raw.collect()) and raw.count() == 3330
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    csv = tmp_path / "c.csv"
    csv.write_text('time,msg\nt1,"a\nb"\n,\nt2,c\n')
    got = read_logs(spark, str(csv), line_numbers=True).collect()
    assert sorted((r.fields["time"], r.source_meta.line_number) for r in got) == [("t1", 2), ("t2", 4)]


def test_sinks(spark, tmp_path):
    from logsieve.sources import read_training_samples, write_json_rows
    from logsieve.sources.sinks import json_rows

    rows = spark.createDataFrame([(1, "a", None), (2, None, 0.5)], "id int, name string, score double")
    write_json_rows(rows, str(tmp_path / "out"))
    assert sorted(map(tuple, spark.read.schema(rows.schema).json(str(tmp_path / "out")).collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    assert [json.loads(r.json) for r in json_rows(rows).collect()] == [{"id": 1, "name": "a"}, {"id": 2, "score": 0.5}]
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        write_json_rows(rows, str(tmp_path / "out"))
    answer = {"incident_id": "i", "summary": "What was seen here", "probable_causes": ["unknown"], "supporting_evidence": ["service=s"], "confidence_score": 0.4, "recommended_next_steps": ["Look"], "limitations": "Few facts only"}
    (tmp_path / "t.jsonl").write_text(json.dumps({"incident": "{}", "explanation": answer}) + "\n\n")
    sample = read_training_samples(spark, str(tmp_path / "t.jsonl")).collect()
    assert len(sample) == 1 and sample[0].explanation.confidence_score == 0.4 and sample[0].incident == "{}"
    (tmp_path / "bad.jsonl").write_text('{"incident": \n')
    with pytest.raises(Exception, match="MALFORMED|malformed|FAILFAST|parse"):
        read_training_samples(spark, str(tmp_path / "bad.jsonl")).collect()


def test_file_errors(spark, tmp_path):
    with pytest.raises(LogIngestionError):
        read_logs(spark, str(tmp_path / "missing.log")).count()
    empty = tmp_path / "e.csv"
    empty.write_text("")
    with pytest.raises(LogIngestionError):
        read_logs(spark, str(empty))
    with pytest.raises(LogIngestionError):
        read_logs(spark, str(empty), "xml")
    bad = tmp_path / "bad.json"
    bad.write_text("[{")
    with pytest.raises(Exception, match="invalid JSON array"):
        read_logs(spark, str(bad)).collect()
    (tmp_path / "e.log").write_text("")
    assert read_logs(spark, str(tmp_path / "e.log")).count() == 0
    assert detect_format("x.NDJSON") == "text" and detect_format("x.JSON") == "json"


def test_engine(spark, tmp_path):
    path = tmp_path / "a.log"
    rows = [f"2031-06-19T{10 + i // 12:02d}:{i % 12 * 5:02d}:10Z INFO shop m{k} (100ms)" for i in range(13) for k in range(3)]
    rows += ["2031-06-19T11:05:20Z ERROR shop boom (9000ms)"] * 30
    path.write_text("\n".join(rows))
    engine = Engine(spark)
    file_id = engine.upload(str(path))
    assert engine.uploads.columns(file_id)[:2] == ["duration_ms", "error_code"]
    found = engine.detect(file_id)
    assert found["anomalies"].where("severity = 'critical'").count() > 0
    incident = engine.incidents().first()
    assert incident.status == "open" and incident.description.startswith("shop incident with ")
    shown = engine.explain(incident.id).first()
    assert shown.likely_cause == "unknown" and shown.affected_services == ["shop"] and shown.confidence == 0.1
    assert engine.compare_to_baseline(file_id, "error_count").count() == 1
    with pytest.raises(KeyError):
        engine.uploads.get("none")


def test_normalize_rejects(spark):
    rows = spark.createDataFrame(
        [("2031-06-19T23:09:12Z", "odd", "Ledger-7", "a   b", 5), ("bad", "INFO", "s", "m", None), ("2031-06-19 23:09:12", "INFO", "@@", "m", None), ("2031-06-19T23:09:12", "INFO", "s", " \t ", None)],
        "timestamp string, level string, service string, message string, duration_ms bigint",
    ).withColumns({"error_code": F.lit(" E1 "), "request_id": F.lit(None).cast("string")})
    got = normalize.normalize_logs(rows).collect()
    assert (got[0].level, got[0].service, got[0].message, got[0].error_code) == ("INFO", "ledger-7", "a b", "E1")
    assert [r.reject_reason for r in got] == [None, "bad timestamp", "bad service", "bad message"]
