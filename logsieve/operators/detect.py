"""Scores, severities, suppression and anomaly events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DetectionConfig
from ..functions import scoring
from ..schemas import FAMILIES
from .baselines import with_baselines
from .features import features_long


def family(feature: Column) -> Column:
    picked = F.lit("other")
    for name, group in FAMILIES.items():
        picked = F.when(feature.isin(*group), name).otherwise(picked)
    return picked


def with_scores(rows: DataFrame, config: DetectionConfig = DetectionConfig()) -> DataFrame:
    """Adds z_score, rate_change, score, severity_rank and direction to rows with a baseline."""
    x, b = F.col("observed"), F.col("baseline")
    df = rows.where("baseline is not null").withColumns(
        {
            "z_score": scoring.zscore(x, b["mean"], b["std"], config.baseline.std_floor),
            "rate_change": scoring.rate_of_change(x, F.col("previous")),
        }
    )
    z, r = F.col("z_score"), F.col("rate_change")
    rank = F.greatest(scoring.severity_rank(z, config.zscore), scoring.severity_rank(r, config.rate_change))
    return df.withColumns(
        {
            "score": scoring.combined_score(z, r, config.zscore, config.rate_change, config.scoring),
            "severity_rank": rank,
            "direction": F.when(x >= b["mean"], "high").otherwise("low"),
        }
    )


def feature_anomalies(features: DataFrame, config: DetectionConfig = DetectionConfig()) -> DataFrame:
    """Scored rows over the floor with a severity: one for each service, window and feature."""
    scored = with_scores(with_baselines(features_long(features), config.baseline), config)
    return scored.where((F.col("score") >= config.scoring.score_floor) & (F.col("severity_rank") > 0))


def suppress(anomalies: DataFrame, enabled: bool = True) -> DataFrame:
    """Adds family, suppressed and suppression_reason: of a family only the best score of a window stays."""
    df = anomalies.withColumn("family", family(F.col("feature")))
    if not enabled:
        return df.withColumns({"suppressed": F.lit(False), "suppression_reason": F.lit(None).cast("string")})
    best = Window.partitionBy("service", "window_start", "family").orderBy(F.desc("score"), "ordinal")
    df = df.withColumn("suppressed", F.row_number().over(best) > 1)
    reason = F.when(F.col("suppressed"), F.concat(F.lit("suppressed_by_"), "family", F.lit("_family")))
    return df.withColumn("suppression_reason", reason)


def stable_id(*parts: Column) -> Column:
    """Deterministic identifier of a row."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 32)


def time_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def event_entry() -> Column:
    """An anomaly in the list of its event."""
    return F.struct(
        "ordinal", "feature", "observed", F.col("baseline.mean").alias("baseline_mean"),
        F.col("baseline.std").alias("baseline_std"), "z_score", "rate_change", "score", "severity_rank", "direction",
    )


def anomaly_events(suppressed: DataFrame) -> DataFrame:
    """A row for each service and window with an active anomaly, its anomalies in feature order."""
    rows = suppressed.where(~F.col("suppressed")).groupBy("service", "window_start")
    events = rows.agg(
        F.max("score").alias("score"),
        F.max("severity_rank").alias("severity_rank"),
        F.array_sort(F.collect_list(event_entry())).alias("anomalies"),  # at most one for each family
    )
    return events.withColumns(
        {
            "event_id": stable_id(F.col("service"), time_text(F.col("window_start"))),
            "severity": scoring.severity_name(F.col("severity_rank")),
        }
    )


def detect(features: DataFrame, config: DetectionConfig = DetectionConfig()) -> DataFrame:
    """Anomaly events of a feature table, in one plan."""
    return anomaly_events(suppress(feature_anomalies(features, config), config.suppress_redundant))


def anomaly_rows(events: DataFrame) -> DataFrame:
    """One row for each anomaly of each event, as the API lists them."""
    rows = events.select("event_id", "service", "window_start", F.explode("anomalies").alias("a"))
    deviation = F.coalesce(F.nullif("a.z_score", F.lit(0.0)), F.nullif("a.rate_change", F.lit(0.0)), F.lit(0.0))
    return rows.select(
        F.concat_ws(":", "event_id", "a.feature").alias("id"),
        "service",
        F.col("window_start").alias("timestamp"),
        F.col("a.feature").alias("feature"),
        F.col("a.observed").alias("observed"),
        F.col("a.baseline_mean").alias("expected"),
        deviation.alias("deviation"),
        F.col("a.score").alias("score"),
        scoring.severity_name(F.col("a.severity_rank")).alias("severity"),
        F.col("a.severity_rank").alias("severity_rank"),
    )


def sort_rows(rows: DataFrame, by: str = "severity", descending: bool = True) -> DataFrame:
    """Order of an anomaly table: by timestamp, service, severity (its rank) or deviation."""
    allowed = {"timestamp": "timestamp", "service": "service", "severity": "severity_rank", "deviation": "deviation"}
    c = F.col(allowed[by])
    return rows.orderBy(c.desc() if descending else c.asc(), "id")
