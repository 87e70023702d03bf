"""Python workers and the library's modules."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent
ROOT = str(PACKAGE.parent)
#: Applications to which the library has been shipped.
_SHIPPED: set[str] = set()


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process, so that they share local folders."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def importable(spark: SparkSession) -> None:
    """Lets workers import the library: from its folder in local mode, from a zip that Spark ships elsewhere."""
    context = spark.sparkContext
    if is_local(spark):
        environment = context.environment
        paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
        if ROOT not in paths:
            environment["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])
    elif context.applicationId not in _SHIPPED:
        archive = os.path.join(tempfile.mkdtemp(prefix="ship-"), f"{PACKAGE.name}.zip")
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for file in sorted(PACKAGE.rglob("*.py")):
                z.write(file, file.relative_to(PACKAGE.parent))
        context.addPyFile(archive)  # the driver serves it to every executor
        _SHIPPED.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; a temporary one in local mode only."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not is_local(spark):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return os.path.join(tempfile.gettempdir(), "logsieve-shared")


def kept(df: DataFrame) -> DataFrame:
    """The rows of ``df`` in a checkpoint of the shared folder: worked out once, whatever becomes of what they were read from."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
