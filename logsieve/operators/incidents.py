"""Incidents: anomaly events of one service, grouped by gaps and by shared feature families."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import IncidentConfig
from ..functions.scoring import severity_name
from ..schemas import FAMILY_NAMES, SEVERITIES
from ..workers import importable, kept
from .detect import family, stable_id, time_text


def _bits(anomalies: Column, bit) -> Column:
    return F.aggregate(anomalies, F.lit(0), lambda m, a: m.bitwiseOR(bit(a)))


def family_bit(feature: Column) -> Column:
    name = family(feature)
    bits = F.lit(1 << (len(FAMILY_NAMES) - 1))
    for i, known in enumerate(FAMILY_NAMES[:-1]):
        bits = F.when(name == known, 1 << i).otherwise(bits)
    return bits


def family_mask(anomalies: Column) -> Column:
    """Bits of the families of an array of anomalies."""
    return _bits(anomalies, lambda a: family_bit(a["feature"]))


def feature_mask(anomalies: Column) -> Column:
    """Bits of the features of an array of anomalies."""
    return _bits(anomalies, lambda a: F.call_function("shiftleft", F.lit(1), a["ordinal"].cast("int")))


def finish_incidents(rows: DataFrame) -> DataFrame:
    """Adds incident_id and severity_counts, for which the counts ``n_<severity>`` leave."""
    entries = F.array(*(F.struct(F.lit(name).alias("k"), F.col(f"n_{name}").alias("v")) for name in SEVERITIES[1:]))
    filled = F.map_filter(F.map_from_entries(entries), lambda _, n: n > 0)
    rows = rows.withColumn("incident_id", stable_id(F.col("service"), time_text(F.col("start_time"))))
    return rows.withColumn("severity_counts", filled).drop(*(f"n_{name}" for name in SEVERITIES[1:]))


def assign_incidents(events: DataFrame, config: IncidentConfig = IncidentConfig()) -> DataFrame:
    """Events with session and part: together with the owner they number the incidents.

    A gap over the limit always splits, so sessions are cut by window functions first.
    Families accumulate in order inside a session only: one pass over its sorted rows that holds
    the families seen, whatever the session's length.
    """
    owner = F.lit("") if config.merge_across_services else F.col("service")
    events = events.withColumn("owner", owner)
    order = Window.partitionBy("owner").orderBy("service", "window_start", "event_id")
    seconds = F.unix_seconds(F.col("window_start").cast("timestamp"))
    gap = seconds - F.lag(seconds).over(order)
    opens = F.when(gap <= config.max_gap_seconds, 0).otherwise(1)
    df = events.withColumn("opens", opens).withColumn("session", F.sum("opens").over(order)).drop("opens")
    if not config.require_feature_family_overlap:
        return df.withColumn("part", F.lit(0))
    importable(events.sparkSession)
    df = df.withColumn("mask", family_mask(F.col("anomalies")))
    keys = ["owner", "session"]
    rows = df.repartition(*keys).sortWithinPartitions(*keys, "service", "window_start", "event_id")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, seen, part = None, 0, 0
        for batch in batches:
            parts = []
            for owner, session, mask in zip(*(batch.column(c).to_pylist() for c in ("owner", "session", "mask")), strict=True):
                if (owner, session) != at:
                    at, seen, part = (owner, session), mask, 0
                elif seen & mask:
                    seen |= mask
                else:
                    seen, part = mask, part + 1
                parts.append(part)
            names = [*batch.schema.names, "part"]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parts, pa.int32())], names=names)

    schema = T.StructType([*df.schema.fields, T.StructField("part", T.IntegerType())])
    return rows.mapInArrow(scan, schema).drop("mask")


def incident_metrics(assigned: DataFrame, config: IncidentConfig = IncidentConfig()) -> DataFrame:
    """incident_id, service, bounds and metrics of each incident."""
    ranked = lambda r: F.size(F.filter("anomalies", lambda a: a["severity_rank"] == r))
    counts = [F.sum(ranked(r)).alias(f"n_{name}") for r, name in enumerate(SEVERITIES) if r]
    rows = assigned.withColumn("bits", feature_mask(F.col("anomalies"))).groupBy("owner", "session", "part")
    rows = rows.agg(
        F.min("service").alias("service"),
        F.min("window_start").alias("start_time"),
        (F.max("window_start") + F.make_dt_interval(secs=F.lit(config.window_size_seconds))).alias("end_time"),
        F.count(F.lit(1)).alias("anomaly_count"),
        F.bit_count(F.bit_or("bits")).cast("bigint").alias("feature_count"),
        F.max("score").alias("max_score"),
        F.max("severity_rank").alias("severity_rank"),
        *counts,
        F.array_sort(
            F.collect_list(F.struct("window_start", "event_id", "score", "severity", "severity_rank", "anomalies"))
        ).alias("events"),
    )
    return finish_incidents(rows.drop("owner", "session", "part"))


def _near(incidents: DataFrame, config: IncidentConfig, keys: list[str], slot_seconds: int) -> DataFrame:
    """Incident ids and their widened bounds, once for each time slot that they touch; ``inner`` slots lie whole inside."""
    wide = F.make_dt_interval(secs=F.lit(config.context_window_seconds))
    df = incidents.select("incident_id", *keys, (F.col("start_time") - wide).alias("lo"), (F.col("end_time") + wide).alias("hi"))
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    slot = lambda c: F.floor(seconds(c) / slot_seconds)
    df = df.withColumn("slot", F.explode(F.sequence(slot("lo"), slot("hi"))))
    inner = (F.col("slot") * slot_seconds >= seconds("lo")) & ((F.col("slot") + 1) * slot_seconds <= seconds("hi"))
    return df.withColumn("inner", inner)


def _slotted(rows: DataFrame, slot_seconds: int) -> DataFrame:
    return rows.withColumn("slot", F.floor(F.unix_seconds(F.col("timestamp").cast("timestamp")) / slot_seconds))


#: Time slots of incidents up to which they are broadcast to the logs: some 20 MB.
PRUNED_SLOTS = 200_000


def log_patterns(
    incidents: DataFrame, logs: DataFrame, config: IncidentConfig = IncidentConfig(), slot_seconds: int = 300, most_slots: int = PRUNED_SLOTS
) -> DataFrame:
    """incident_id, key, count, sample_message, place: the most frequent messages around each incident.

    The slots that incidents touch are worked out first. Unless there are over ``most_slots``, they are broadcast: logs outside of
    them are dropped where they are read, those at the two ends of an incident's range are compared with its bounds there, and both are
    counted before anything is shuffled. Beyond that the joins are shuffled ones. Ties go to the pattern seen first.
    """
    near = kept(_near(incidents, config, ["service"], slot_seconds))
    few = F.broadcast if near.count() <= most_slots else (lambda rows: rows)
    key = F.coalesce(F.nullif(F.col("message_hash"), F.lit("")), F.col("message"))
    lines = _slotted(logs.select("service", "timestamp", key.alias("key"), "message", "request_id"), slot_seconds)
    seen = F.struct("timestamp", "request_id", "message").alias("seen")
    whole, ends, slot = near.where("inner"), near.where("NOT inner"), ["service", "slot"]
    counted = lines.join(few(whole.select(*slot).distinct()), slot, "left_semi")
    counted = counted.groupBy(*slot, "key").agg(F.count(F.lit(1)).alias("n"), F.min(seen).alias("seen"))
    inside = whole.join(counted, slot).select("incident_id", "key", "n", "seen")
    at_ends = lines.join(few(ends), slot).where(F.col("timestamp").between(F.col("lo"), F.col("hi")))
    at_ends = at_ends.groupBy("incident_id", "key").agg(F.count(F.lit(1)).alias("n"), F.min(seen).alias("seen"))
    totals = inside.unionByName(at_ends).groupBy("incident_id", "key").agg(F.sum("n").alias("count"), F.min("seen").alias("seen"))
    best = Window.partitionBy("incident_id").orderBy(F.desc("count"), "seen", "key")
    ranked = totals.withColumn("place", F.row_number().over(best)).where(F.col("place") <= config.max_log_patterns)
    return ranked.select("incident_id", "key", "count", F.col("seen.message").alias("sample_message"), "place")


def operational_context(
    incidents: DataFrame, operations: DataFrame, config: IncidentConfig = IncidentConfig(), slot_seconds: int = 3600
) -> DataFrame:
    """incident_id, event_type, timestamp, description, metadata (if the operations have it), place: the first operations
    around each incident.

    Of a slot that lies whole inside an incident's range only its first operations can count, so no more of it are joined.
    """
    near = _near(incidents, config, [], slot_seconds)
    order = ("timestamp", "event_type", "description")
    slotted = _slotted(operations, slot_seconds)
    ahead = slotted.withColumn("__n", F.row_number().over(Window.partitionBy("slot").orderBy(*order)))
    ahead = ahead.where(F.col("__n") <= config.max_operational_events).drop("__n")
    joined = near.where("inner").join(ahead, "slot").unionByName(near.where("NOT inner").join(slotted, "slot"))
    joined = joined.where(F.col("timestamp").between(F.col("lo"), F.col("hi")))
    first = Window.partitionBy("incident_id").orderBy(*order)
    ranked = joined.withColumn("place", F.row_number().over(first))
    ranked = ranked.where(F.col("place") <= config.max_operational_events)
    return ranked.drop("slot", "lo", "hi", "inner")


def build_incidents(
    events: DataFrame,
    logs: DataFrame | None = None,
    operations: DataFrame | None = None,
    config: IncidentConfig = IncidentConfig(),
) -> DataFrame:
    """Incidents with log_patterns and operational_context (empty arrays where nothing is given or found).

    With logs or operations the incidents, which are few, are worked out at once and kept in a checkpoint: every join needs them.
    """
    incidents = incident_metrics(assign_incidents(events, config), config)
    if logs is not None or operations is not None:
        incidents = kept(incidents)
    none_p = F.array().cast("array<struct<key:string,count:bigint,sample_message:string>>")
    none_o = F.array().cast("array<struct<event_type:string,timestamp:timestamp_ntz,description:string,metadata:map<string,string>>>")
    out = incidents
    if logs is not None:
        entry = F.struct("place", F.struct("key", "count", "sample_message").alias("p"))
        each = log_patterns(incidents, logs, config).groupBy("incident_id").agg(F.array_sort(F.collect_list(entry)).alias("ps"))
        each = each.select("incident_id", F.transform("ps", lambda x: x["p"]).alias("log_patterns"))
        out = out.join(each, "incident_id", "left").withColumn("log_patterns", F.coalesce("log_patterns", none_p))
    else:
        out = out.withColumn("log_patterns", none_p)
    if operations is not None:
        entry = F.struct("place", F.struct("event_type", "timestamp", "description", "metadata").alias("p"))
        if "metadata" not in operations.columns:
            operations = operations.withColumn("metadata", F.lit(None).cast("map<string,string>"))
        each = operational_context(incidents, operations, config)
        by_place = F.array_sort(F.collect_list(entry), lambda a, b: a["place"] - b["place"])  # maps have no order
        each = each.groupBy("incident_id").agg(by_place.alias("ps"))
        each = each.select("incident_id", F.transform("ps", lambda x: x["p"]).alias("operational_context"))
        out = out.join(each, "incident_id", "left")
        out = out.withColumn("operational_context", F.coalesce("operational_context", none_o))
    else:
        out = out.withColumn("operational_context", none_o)
    return out


def in_order(incidents: DataFrame) -> DataFrame:
    return incidents.orderBy("service", "start_time")


def incident_rows(incidents: DataFrame) -> DataFrame:
    """One row for each incident, as the API lists them."""
    text = F.concat("service", F.lit(" incident with "), F.col("anomaly_count").cast("string"), F.lit(" anomaly windows detected."))
    return incidents.select(
        F.col("incident_id").alias("id"),
        "service",
        F.col("start_time").alias("timestamp"),
        severity_name(F.col("severity_rank")).alias("severity"),
        text.alias("description"),
        F.lit("open").alias("status"),
    )


def find_incident(incidents: DataFrame, incident_id: str) -> DataFrame:
    return incidents.where(F.col("incident_id") == incident_id)
