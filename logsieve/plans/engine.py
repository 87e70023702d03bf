"""Source to features, anomalies, incidents and explanations; lazy plans, but for incidents, which are worked out when asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..config import Settings
from ..operators import detect, explain, incidents, normalize, parse
from ..operators.features import window_features
from ..operators.stats import above_baseline, statistics
from ..sources import UploadRegistry, detect_format, read_logs


def canonical_logs(raw: DataFrame, parser: parse.Parser | None = None) -> DataFrame:
    """Accepted canonical logs of raw rows."""
    parsed = parse.accepted(parse.parse_logs(raw, parser))
    return parse.accepted(normalize.normalize_logs(parsed))


def features_of_file(spark: SparkSession, path: str, fmt: str = "auto", settings: Settings = Settings()) -> DataFrame:
    return window_features(canonical_logs(read_logs(spark, path, fmt)), settings.window.seconds)


class Engine:
    """What the service endpoints do, as plans over registered files."""

    def __init__(self, spark: SparkSession, settings: Settings = Settings(), model: explain.Model | None = None):
        self.spark, self.settings, self.model = spark, settings, model
        self.uploads = UploadRegistry()

    def upload(self, path: str, fmt: str = "auto") -> str:
        fmt = detect_format(path) if fmt == "auto" else fmt
        options = {"line_numbers": True} | ({"keep_malformed": True} if fmt == "json" else {})
        parsed = parse.parse_logs(read_logs(self.spark, path, fmt, **options))
        logs = normalize.normalize_logs(parse.accepted(parsed))
        good = parse.accepted(logs)
        return self.uploads.add(
            path, parsed=parse.accepted(parsed), logs=good, features=window_features(good, self.settings.window.seconds),
            parse_quality=parse.quality_report(parsed), normalize_quality=parse.quality_report(logs),
        )

    def detect(self, file_id: str, operations: DataFrame | None = None) -> dict[str, DataFrame]:
        """anomalies and incidents, as the API lists them."""
        tables = self.uploads.get(file_id)
        events = detect.detect(tables["features"], self.settings.detection)
        found = incidents.build_incidents(events, tables["logs"], operations, self.settings.incident)
        self.uploads.put(file_id, events=events, incidents=found)
        return {"anomalies": detect.anomaly_rows(events), "incidents": incidents.incident_rows(found)}

    def incidents(self) -> DataFrame:
        """Incidents of the file that was looked at last."""
        if self.uploads.active is None:
            raise KeyError("no file has been analysed")
        return incidents.in_order(incidents.incident_rows(self.uploads.get(self.uploads.active)["incidents"]))

    def explain(self, incident_id: str) -> DataFrame:
        found = incidents.find_incident(self.uploads.get(self.uploads.active)["incidents"], incident_id)
        return explain.explanation_rows(explain.explain(found, self.model))

    def compare_to_baseline(self, file_id: str, feature: str, multiplier: float = 2.0) -> DataFrame:
        features = self.uploads.get(file_id)["features"]
        return above_baseline(features, feature, statistics(features, feature), multiplier)
