"""Baselines of each (service, feature) from earlier observations only.

Rows are long features. Every observation, anomalous or not, becomes history of
the later ones; windows without a value are no observation.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import BaselineConfig

PARTITION = ("service", "feature")


def _history(rows: int | None = None):
    start = Window.unboundedPreceding if rows is None else -rows
    return Window.partitionBy(*PARTITION).orderBy("window_start").rowsBetween(start, -1)


def _stats(mean: Column, std: Column, count: Column, method: str, ready: Column) -> Column:
    return F.when(
        ready, F.struct(mean.alias("mean"), std.alias("std"), count.cast("bigint").alias("count"), F.lit(method).alias("method"))
    )


def rolling_baseline(config: BaselineConfig) -> Column:
    w = _history(config.window_size)
    n = F.count("observed").over(w)
    std = F.greatest(F.stddev_pop("observed").over(w), F.lit(config.std_floor))
    return _stats(F.avg("observed").over(w), std, n, "rolling", n >= config.min_points)


#: What a block's end keeps of the block's beginning, at most.
FORGOTTEN = 1e-100


def ewma_block(alpha: float) -> int:
    """Observations after which what is older weighs less than ``FORGOTTEN``."""
    return max(1, math.ceil(math.log(FORGOTTEN) / math.log(1 - alpha)))


def _with_ewma(df: DataFrame, config: BaselineConfig) -> DataFrame:
    """Exponentially weighted mean and variance of all earlier observations, as sums over windows.

    With q = 1 - alpha the recursion m' = m + alpha (x - m), v' = q v + alpha (x - m')^2 is linear in (1, m, m^2, v). A series
    is cut into blocks of ``ewma_block`` observations. Inside a block, from its first value r on as if that had been the mean,
    sums of observations and squared deviations weighted by powers of 1/q give the mean and variance that the block makes
    alone; the carried mean, as its distance from r, and the carried variance add their shares. What a block carries on is its own end.
    """
    q, a, size = 1 - config.ewma_alpha, config.ewma_alpha, ewma_block(config.ewma_alpha)
    series = Window.partitionBy(*PARTITION).orderBy("window_start")
    block = Window.partitionBy(*PARTITION, "__block").orderBy("window_start")
    before, upto = block.rowsBetween(Window.unboundedPreceding, -1), block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    past = F.row_number().over(series) - 1
    power = lambda n: F.pow(F.lit(q), n)
    none = lambda c: F.coalesce(c, F.lit(0.0))
    j = F.col("__j")  # place in the block, from 0: so many observations of the block are history
    df = df.withColumn("__n", past).withColumns({"__block": F.floor(F.col("__n") / size), "__j": F.col("__n") % size})
    df = df.withColumn("__r", F.first("observed").over(upto))
    df = df.withColumn("__y", F.col("observed") - F.col("__r"))
    df = df.withColumn("__p", a * power(j) * none(F.sum(F.col("__y") * power(-(j + 1))).over(before)))  # the block's own mean before the row, less r
    df = df.withColumn("__d", F.col("__y") - F.col("__p"))
    scaled = F.col("__d") * F.col("__d") * power(-(j + 1))
    df = df.withColumns({"__a": none(F.sum(scaled).over(before)), "__b": none(F.sum("__d").over(before))})
    own = a * q * q * power(j) * F.col("__a")
    last = F.struct(
        (F.col("__r") + q * F.col("__p") + a * F.col("__y")).alias("m"),
        (q * own + a * q * q * F.col("__d") * F.col("__d")).alias("v"),
    )
    carried = F.last(F.when(j == size - 1, last), ignorenulls=True).over(series.rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("__c", carried)
    far = F.coalesce(F.col("__c.m") - F.col("__r"), F.lit(0.0))
    mean = F.col("__r") + F.col("__p") + power(j) * far
    cross = a * q * q * power(j - 1) * F.col("__b")
    square = power(j + 1) * (1 - power(j))
    variance = power(j) * none(F.col("__c.v")) + own - 2 * cross * far + square * far * far
    std = F.greatest(F.sqrt(F.greatest(variance, F.lit(0.0))), F.lit(config.std_floor))
    stats = _stats(mean, std, F.col("__n"), "ewma", F.col("__n") >= config.min_points)
    return df.withColumn("__ewma", stats).drop("__n", "__block", "__j", "__r", "__y", "__p", "__d", "__a", "__b", "__c")


def _hybrid(rolling: Column, ewma: Column) -> Column:
    both = F.struct(
        rolling["mean"].alias("mean"),
        F.greatest(rolling["std"], ewma["std"]).alias("std"),
        F.least(rolling["count"], ewma["count"]).alias("count"),
        F.lit("hybrid").alias("method"),
    )
    return F.when(rolling.isNotNull() & ewma.isNotNull(), both).otherwise(F.coalesce(rolling, ewma))


def with_baselines(long: DataFrame, config: BaselineConfig = BaselineConfig()) -> DataFrame:
    """Adds previous (the last observation) and baseline {mean, std, count, method}, null while history is short."""
    df = long.withColumn("previous", F.lag("observed").over(Window.partitionBy(*PARTITION).orderBy("window_start")))
    if config.strategy != "ewma":
        df = df.withColumn("__rolling", rolling_baseline(config))
    if config.strategy != "rolling":
        df = _with_ewma(df, config)
    chosen = {
        "rolling": lambda: F.col("__rolling"),
        "ewma": lambda: F.col("__ewma"),
        "hybrid": lambda: _hybrid(F.col("__rolling"), F.col("__ewma")),
    }[config.strategy]()
    return df.withColumn("baseline", chosen).drop("__rolling", "__ewma")
