"""Eleven features of each service and window.

Order statistics are exact and use counted values, so the state of a group is
bounded by its distinct durations. All features together come from one plain
count of values; families alone (also in streams) are single aggregations.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import FEATURES
from .windows import window_start

#: Value at index floor(0.95 n) of the sorted values. The discrete percentile takes index
#: ceil(p n) - 1, which is one less if 0.95 n is whole; the small addition makes them equal.
P95 = 0.95 + 1e-12


def _level(*levels: str) -> Column:
    return F.count_if(F.col("level").isin(*levels))


def count_features() -> dict[str, Column]:
    return {
        "total_events": F.count(F.lit(1)),
        "error_count": _level("ERROR", "CRITICAL"),
        "warning_count": _level("WARNING"),
        "info_count": _level("INFO"),
    }


def rate_features() -> dict[str, Column]:
    total = F.count(F.lit(1))
    return {"error_rate": _level("ERROR", "CRITICAL") / total, "warning_rate": _level("WARNING") / total}


def duration_features() -> dict[str, Column]:
    return {
        "median_duration_ms": F.median("duration_ms"),
        "p95_duration_ms": F.expr(f"percentile_disc({P95!r}D) within group (order by duration_ms)").cast("double"),
        "max_duration_ms": F.max("duration_ms").cast("double"),
    }


def diversity_features() -> dict[str, Column]:
    return {
        "unique_messages": F.count_distinct(F.nullif(F.col("message_hash"), F.lit(""))),
        "unique_error_codes": F.count_distinct(F.nullif(F.col("error_code"), F.lit(""))),
    }


def all_features() -> dict[str, Column]:
    return count_features() | rate_features() | duration_features() | diversity_features()


def window_features(logs: DataFrame, seconds: int = 300, aggregates: dict[str, Column] | None = None) -> DataFrame:
    """service, window_start and the features (all, or those of ``aggregates``)."""
    rows = logs.withColumn("window_start", window_start(F.col("timestamp"), seconds))
    if aggregates is None:
        return _from_counts(_counted(rows))
    return rows.groupBy("service", "window_start").agg(*(c.alias(n) for n, c in aggregates.items()))


def _counted(rows: DataFrame) -> DataFrame:
    """Rows of each level and duration, each message and each error code of a window.

    Plain counts: combined before the shuffle, and a hot window spreads over its values.
    """
    value = lambda c: F.nullif(F.col(c), F.lit("")).alias(c)
    rows = rows.select("service", "window_start", "level", "duration_ms", value("message_hash"), value("error_code"))
    keys = ["service", "window_start"]
    sets = [[*keys, "level", "duration_ms"], [*keys, "message_hash"], [*keys, "error_code"]]
    counted = rows.groupingSets(sets, *keys, "level", "duration_ms", "message_hash", "error_code")
    return counted.agg(F.count(F.lit(1)).alias("n"), (F.grouping("level") == 0).alias("of_level"))


#: Leading binary digits of a duration that name its bucket.
DIGITS = 12


def bucket_of(value: Column) -> Column:
    """``value`` without all but its leading digits: what is no larger falls into no later bucket. Up to 4,095 a bucket is one value."""
    shift = F.greatest(F.length(F.bin(value)) - DIGITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def _from_counts(counted: DataFrame) -> DataFrame:
    """Features of counted values.

    Median and 95th percentile are selected in two steps: counts by bucket say which bucket has the wanted place,
    counts inside that bucket which value. Nothing holds a window's values together: a window has no more than some thousand
    buckets, and a bucket's values are a sorted run.
    """
    keys, zero = ["service", "window_start"], F.lit(0).cast("bigint")
    of = lambda *levels: F.coalesce(F.sum(F.when(F.col("level").isin(*levels), F.col("n"))), zero)
    counted = counted.withColumn("bucket", bucket_of(F.col("duration_ms")))
    buckets = counted.groupBy(*keys, "bucket").agg(
        F.sum(F.when(F.col("of_level"), F.col("n"))).alias("total_events"),
        of("ERROR", "CRITICAL").alias("error_count"),
        of("WARNING").alias("warning_count"),
        of("INFO").alias("info_count"),
        F.sum(F.when(F.col("duration_ms").isNotNull(), F.col("n"))).alias("timed"),
        F.max("duration_ms").alias("max_duration_ms"),
        F.count("message_hash").alias("unique_messages"),
        F.count("error_code").alias("unique_error_codes"),
    )
    window = Window.partitionBy(*keys)
    first = F.coalesce(F.sum("timed").over(window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    buckets = buckets.withColumns({"first": first, "all": F.sum("timed").over(window)})
    places = {
        "low": F.floor((F.col("all") - 1) / 2),
        "high": F.floor(F.col("all") / 2),
        "p95": F.least(F.floor(F.col("all") * 0.95), F.col("all") - 1),
    }
    here = lambda c: (F.col("first") <= c) & (c < F.col("first") + F.col("timed"))
    target = lambda c: F.max(F.when(here(c), F.struct("bucket", (c - F.col("first")).alias("place"))))
    wide = buckets.groupBy(*keys).agg(
        *(F.sum(c).alias(c) for c in ("total_events", "error_count", "warning_count", "info_count", "unique_messages", "unique_error_codes")),
        F.max("max_duration_ms").cast("double").alias("max_duration_ms"),
        *(target(c).alias(name) for name, c in places.items()),
    )
    kept = [c for c in wide.columns if c not in (*keys, *places)]
    # A window without durations asks for the first of its rows that have none.
    ask = lambda name: F.struct(
        F.lit(name).alias("name"), F.col(name).isNotNull().alias("has"), F.coalesce(f"{name}.bucket", zero).alias("bucket"), F.coalesce(f"{name}.place", zero).alias("place")
    )
    asked = wide.select(*keys, F.struct(*kept).alias("rest"), F.inline(F.array(*map(ask, places))))
    # Unfolded, not filtered: the counts below stay one plan, which both steps share.
    row = F.struct(*keys, F.col("duration_ms").isNotNull().alias("has"), F.coalesce("bucket", zero).alias("bucket"), "duration_ms", "n")
    values = counted.select(F.inline(F.when(F.col("of_level"), F.array(row))))
    inside = Window.partitionBy(*keys, "bucket", "name").orderBy("duration_ms", "n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Null-safe, so that no filter on the keys goes below one side's counts only.
    on = [*keys, "has", "bucket"]
    asked = asked.withColumnsRenamed({c: f"__{c}" for c in on})
    same = functools.reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in on))
    found = values.join(asked, same).withColumn("upto", F.sum("n").over(inside))
    chosen = found.where((F.col("upto") > F.col("place")) & (F.col("upto") - F.col("n") <= F.col("place")))
    value = lambda name: F.max(F.when(F.col("name") == name, F.col("duration_ms"))).cast("double")
    df = chosen.groupBy(*keys).agg(
        F.max("rest").alias("rest"), ((value("low") + value("high")) / 2).alias("median_duration_ms"), value("p95").alias("p95_duration_ms")
    )
    df = df.select(*keys, "rest.*", "median_duration_ms", "p95_duration_ms")
    rates = {"error_rate": F.col("error_count") / F.col("total_events"), "warning_rate": F.col("warning_count") / F.col("total_events")}
    return df.select(*keys, *(rates.get(f, F.col(f)).alias(f) for f in all_features()))


def at_share(timed: Column, share: float) -> Column:
    """Value at index floor(share * n) of the n values that a sorted array of (value, count) stands for."""
    zero = F.lit(0).cast("bigint")
    index = F.floor(F.aggregate(timed, zero, lambda a, x: a + x["n"]) * share)
    start = F.struct(zero.alias("seen"), F.lit(None).cast("bigint").alias("value"))
    step = lambda a, x: F.when(a["seen"] > index, a).otherwise(
        F.struct((a["seen"] + x["n"]).alias("seen"), x["duration_ms"].alias("value"))
    )
    return F.aggregate(timed, start, step)["value"]


def features_long(features: DataFrame) -> DataFrame:
    """A row for each feature that has a value: service, window_start, feature, ordinal, observed."""
    values = [F.col(f).cast("double").alias(f) for f in FEATURES]
    wide = features.select("service", "window_start", *values)
    rows = wide.unpivot(["service", "window_start"], list(FEATURES), "feature", "observed").where("observed is not null")
    return rows.withColumn("ordinal", F.array_position(F.array(*map(F.lit, FEATURES)), F.col("feature")) - 1)
