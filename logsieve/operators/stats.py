"""Statistics over feature tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..workers import importable

#: Binary digits of a value that one step of the median's selection decides.
DIGITS = 16


def _median(rows: DataFrame, total: DataFrame) -> DataFrame:
    """One row, ``median``: of the column ``v`` of ``rows`` without nulls, ``total`` having their number ``n``; null if there are none.

    The two middle places are selected from counts by leading digits of an integer that is ordered as the values are, in four steps:
    each counts the next digits of what has the digits found so far. Counts are combined before they are shuffled, so that a task
    sees no more than 2^16 of them for each task before it and place, however many values there are.
    """
    importable(rows.sparkSession)

    @F.pandas_udf("bigint")
    def ordered(v: pd.Series) -> pd.Series:
        values = v.to_numpy(np.float64) + 0.0
        bits = values.view(np.int64)
        most = np.int64(2**63 - 1)
        return pd.Series(np.where(np.isnan(values), most, np.where(bits < 0, bits ^ most, bits)))

    rows = rows.withColumn("key", ordered("v"))
    place = F.posexplode(F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2))).alias("name", "place")
    asked, counts = total.select(place), [F.count(F.lit(1)).alias("n"), F.min("v").alias("v")]
    for shift in range(64 - DIGITS, -1, -DIGITS):
        digits = F.shiftright("key", shift).alias("digits")
        if shift == 64 - DIGITS:
            counted = rows.groupBy(digits).agg(*counts).crossJoin(F.broadcast(asked))
        else:
            same = F.shiftright("key", shift + DIGITS) == F.col("begin")
            counted = rows.join(F.broadcast(asked.drop("v")), same).groupBy("name", "place", digits).agg(*counts)
        upto = F.sum("n").over(Window.partitionBy("name").orderBy("digits").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        found = counted.withColumn("before", upto - F.col("n")).where("before <= place AND place < before + n")
        asked = found.select("name", (F.col("place") - F.col("before")).alias("place"), F.col("digits").alias("begin"), "v")
    low, high = (F.max(F.when(F.col("name") == i, F.col("v"))) for i in (0, 1))
    return asked.agg(F.when(low == high, low).otherwise(low * 0.5 + high * 0.5).alias("median"))


def statistics(df: DataFrame, column: str) -> DataFrame:
    """One row: min, max, mean, median, stdev (sample; 0 of one value). Fails on a table without values."""
    c = F.col(column).cast("double")
    row = df.agg(
        F.count(c).alias("n"), F.min(c).alias("min"), F.max(c).alias("max"), F.avg(c).alias("mean"),
        F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias("stdev"),
    )
    median = _median(df.select(c.alias("v")).where("v IS NOT NULL"), row.select("n"))
    checked = F.when(F.col("n") == 0, F.raise_error(F.lit(f"no values of {column}"))).otherwise(F.col("min"))
    return row.crossJoin(F.broadcast(median)).select(checked.alias("min"), "max", "mean", "median", "stdev")


def above_baseline(df: DataFrame, column: str, stats: DataFrame, multiplier: float = 2.0) -> DataFrame:
    """Rows whose value exceeds the mean of ``stats`` (one row) times ``multiplier``."""
    mean = stats.select(F.col("mean").alias("__mean")).limit(1)
    # One row by construction, so a broadcast of fixed size.
    rows = df.join(F.broadcast(mean), F.col(column) > F.col("__mean") * multiplier, "inner")
    return rows.drop("__mean")
