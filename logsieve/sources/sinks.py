"""JSON rows out, training samples in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import TRAINING_SAMPLE


def json_rows(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("json"))


def write_json_rows(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def read_training_samples(spark: SparkSession, path: str) -> DataFrame:
    """incident (JSON text) and explanation of a JSON-lines file; blank lines are skipped, bad ones fail."""
    return spark.read.schema(TRAINING_SAMPLE).option("mode", "FAILFAST").json(path)
