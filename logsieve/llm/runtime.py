"""Helpers shared by the training-data operators: tables, checkpoints, sizes."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workers import shared_folder

#: Word separators of every contract: blank and the five ASCII controls 0x09-0x0D.
SPACE_CLASS = r"[\x20\x09-\x0D]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def durable(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: computes once, cuts lineage, survives lost executors.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; without one this fails, but for
    local mode (tests). Spark removes a checkpoint when its table isn't used any more if the session sets
    ``spark.cleaner.referenceTracking.cleanCheckpoints``, which this library recommends.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(c):
    """Lower-case A-Z only. Pure-ASCII text takes the byte-wise path of lower()."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def words_of(c):
    """Array of the non-separator runs of ``c``; empty array for null."""
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), SPACE_CLASS + "+"), "")


def give_back() -> None:
    """Returns freed memory of this worker to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``work`` of mapInArrow that leaves no freed memory in its worker, which Spark keeps for later stages."""

    @functools.wraps(work)
    def run(batches: Iterator) -> Iterator:
        give_back()
        try:
            yield from work(batches)
        finally:
            give_back()

    return run
