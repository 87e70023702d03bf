"""Scalar functions and configuration."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from logsieve.config import BaselineConfig, DetectionConfig, IncidentConfig, WindowConfig, load_settings
from logsieve.functions import normal, scoring
from logsieve.schemas import FEATURES, family_of


def one(spark, value, f):
    row = spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()
    return row.y


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("2031-11-05T23:59:07Z", "2031-11-05 23:59:07"), ("2031-11-05T23:59:07", "2031-11-05 23:59:07"),
        (" 2031-11-05 23:59:07 ", "2031-11-05 23:59:07"), ("2031-11-05T23:59:07.25Z", "2031-11-05 23:59:07.250000"),
        ("1951689547", "2031-11-05 23:59:07"), ("1951689547000", "2031-11-05 23:59:07"), ("2031-3-9T1:2:3Z", "2031-03-09 01:02:03"),
        ("0", "1970-01-01 00:00:00"), ("not-a-timestamp", None), ("", None), ("nan", None), ("inf", None), ("1e30", None),
        ("2031-11-05T23:59:07+02:00", None), ("2031-11-05 23:59:07.5", None), (None, None),
    ],
)
def test_timestamp(spark, text, expected):
    got = one(spark, text, normal.timestamp)
    assert (None if got is None else str(got)) == expected


@pytest.mark.parametrize(("text", "expected"), [("warn", "WARNING"), (" Err ", "ERROR"), ("CRIT", "CRITICAL"), ("fatal", "CRITICAL"), ("UNKNOWN", None), (None, None)])
def test_level(spark, text, expected):
    assert one(spark, text, normal.level) == expected


@pytest.mark.parametrize(("text", "expected"), [("Ledger_7.EU", "ledger_7.eu"), ("  mailer  ", "mailer"), ("q" * 131, "q" * 128), ("shop%front!9", "shopfront9"), ("@", None)])
def test_service(spark, text, expected):
    assert one(spark, text, normal.service) == expected


def test_message(spark):
    assert one(spark, "Multiple    spaces \n here ", normal.message) == "Multiple spaces here"
    assert len(one(spark, "x" * 3000, normal.message)) == 2048
    assert one(spark, "  ", normal.message) is None
    assert one(spark, "Same message", lambda c: normal.message_hash(normal.message(c))) == "23f5a7f782386a8c"


@pytest.mark.parametrize(("text", "expected"), [("1500", 1500), ("1500.5", 1500), ("0", None), ("-100", None), (None, None), ("soon", None), ("0.5", 0), ("inf", None), ("nan", None)])
def test_duration(spark, text, expected):
    assert one(spark, text, normal.duration) == expected


def test_detectors(spark):
    z, small, rate, none = spark.range(1).select(
        scoring.zscore(F.lit(14.0), F.lit(10.0), F.lit(2.0), 1e-6),
        scoring.zscore(F.lit(14.0), F.lit(10.0), F.lit(1e-9), 1e-6),
        scoring.rate_of_change(F.lit(20.0), F.lit(10.0)),
        scoring.rate_of_change(F.lit(20.0), F.lit(None).cast("double")),
    ).first()
    assert (z, small, rate, none) == (2.0, None, 1.0, None)


@pytest.mark.parametrize(("z", "rank"), [(2.4, 0), (2.5, 1), (-3.5, 2), (5.0, 3), (7.0, 4), (None, 0)])
def test_severity(spark, z, rank):
    got = spark.range(1).select(scoring.severity_rank(F.lit(z).cast("double"), DetectionConfig().zscore)).first()[0]
    assert got == rank


def test_config():
    for bad in (lambda: BaselineConfig(window_size=2), lambda: BaselineConfig(strategy="x"), lambda: BaselineConfig(ewma_alpha=1.0), lambda: WindowConfig(0), lambda: IncidentConfig(window_size_seconds=0)):
        with pytest.raises(ValueError):
            bad()
    got = load_settings(environ={"LOGSIEVE_WINDOW": '{"seconds": 60}', "LOGSIEVE_DETECTION": '{"baseline": {"strategy": "ewma"}}'})
    assert got.window.seconds == 60 and got.detection.baseline.strategy == "ewma"
    with pytest.raises(ValueError):
        load_settings(environ={"LOGSIEVE_WINDOW": '{"hours": 1}'})
    assert len(FEATURES) == 11 and family_of("error_rate") == "rate" and family_of("x") == "other"
