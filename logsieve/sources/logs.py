"""Readers for text, JSON and CSV logs, and an adapter for any DataFrame.

``line_numbers=True`` adds physical line numbers (of CSV: 2 for the first row after the header) from counts of lines by
file block, so files stay splittable; it costs a second pass that counts lines. The default leaves the number null.
"""

from __future__ import annotations

import functools
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..schemas import SOURCE_META
from .arrays import RANGE_BYTES, array_flags, list_files, read_items
from .custom import FORMATS

_BOM = "\ufeff"


class LogIngestionError(Exception):
    """A source is missing, empty where that is fatal, or in an unknown format."""


def _load(reader, path: str) -> DataFrame:
    try:
        return reader(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise LogIngestionError(f"log source not found: {path}") from error
        raise


def _meta(fmt: str, source: Column, line: Column | None = None, idx: Column | None = None) -> Column:
    null = F.lit(None).cast("bigint")
    return F.struct(
        source.alias("source"),
        (null if line is None else line.cast("bigint")).alias("line_number"),
        (null if idx is None else idx.cast("bigint")).alias("idx"),
        F.lit(fmt).alias("format"),
    ).cast(SOURCE_META)


def _placed(rows: DataFrame) -> DataFrame:
    """Adds __file, __block and __id, which rises by one from row to row of a block."""
    return rows.select(
        "*",
        F.col("_metadata.file_path").alias("__file"),
        F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__id"),
    )


def _numbered(placed: DataFrame, first: int = 1) -> DataFrame:
    """Adds __line: the row's place in its file, from ``first`` on."""
    blocks = placed.groupBy("__file", "__block").agg(F.count(F.lit(1)).alias("n"), F.min("__id").alias("__start"))
    before = Window.partitionBy("__file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("__before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    line = F.col("__id") - F.col("__start") + F.col("__before") + first
    return placed.join(blocks, ["__file", "__block"]).withColumn("__line", line).drop("__start", "__before")


def _bare(c: Column) -> Column:
    return strip(F.regexp_replace(c, f"^{_BOM}", ""))


def _lines(spark: SparkSession, path: str, numbered: bool) -> tuple[DataFrame, Column | None]:
    lines = _placed(_load(spark.read.text, path))
    return (_numbered(lines), F.col("__line")) if numbered else (lines, None)


def read_text_logs(spark: SparkSession, path: str, line_numbers: bool = False) -> DataFrame:
    """value, source_meta: stripped lines, blank ones dropped, a byte-order mark removed."""
    lines, number = _lines(spark, path, line_numbers)
    meta = _meta("text", F.col("__file"), line=number)
    return lines.select(_bare(F.col("value")).alias("value"), meta.alias("source_meta")).where("value <> ''")


def _whole_arrays(spark: SparkSession, names: DataFrame, path: str) -> DataFrame:
    """name, idx, value of the items of files that can't be read by ranges: a file is one row."""
    whole = spark.read.text(path, wholetext=True).withColumn("name", F.col("_metadata.file_path"))
    whole = whole.join(names, "name", "left_semi").select("name", _bare(F.col("value")).alias("value")).where("value <> ''")
    items = F.from_json("value", "array<string>", {"mode": "PERMISSIVE"})
    checked = F.when(items.isNull(), F.raise_error(F.lit("invalid JSON array"))).otherwise(items)
    rows = whole.select("name", F.posexplode(checked).alias("idx", "value"))
    return rows.select("name", F.col("idx").cast("bigint").alias("idx"), "value")


def _array_items(spark: SparkSession, files: DataFrame, path: str, range_bytes: int) -> DataFrame:
    """name, idx and value of the items of array files, with an error for an item that is no JSON."""
    by_ranges = read_items(files.where("ranged"), range_bytes)
    rows = by_ranges
    if files.where("NOT ranged").take(1):
        rows = rows.unionByName(_whole_arrays(spark, files.where("NOT ranged").select("name"), path))
    valid = F.size(F.from_json(F.concat(F.lit("["), "value", F.lit("]")), "array<string>")) == 1  # in brackets nothing may follow it
    broken = F.raise_error(F.concat(F.lit("invalid JSON array: item "), F.col("idx").cast("string"), F.lit(" of "), F.col("name")))
    return rows.withColumn("value", F.when(valid, F.col("value")).otherwise(broken))


def _shapes(spark: SparkSession, path: str, shape: str) -> DataFrame:
    """name, path, length, ranged and is_array of each file. What tasks can't open is judged by its first line that isn't blank."""
    files = _load(lambda p: list_files(spark, p), path)
    if shape != "auto":
        return files.withColumn("is_array", F.lit(shape == "array"))
    flags = array_flags(files.where("ranged")).withColumn("ranged", F.lit(True))
    if not files.where("NOT ranged").take(1):
        return flags
    heads = _placed(spark.read.text(path)).where("__block = 0").withColumn("value", F.substring(_bare(F.col("value")), 1, 1))
    heads = heads.where("value <> ''").groupBy("__file").agg(F.min_by("value", "__id").alias("head"))
    rest = files.where("NOT ranged").join(heads, F.col("name") == F.col("__file"), "left")
    return flags.unionByName(rest.select("name", "path", "length", (F.col("head") == "[").alias("is_array"), "ranged"))


def read_json_logs(
    spark: SparkSession, path: str, line_numbers: bool = False, shape: str = "auto", keep_malformed: bool = False,
    range_bytes: int = RANGE_BYTES,
) -> DataFrame:
    """fields, source_meta. Each file that begins with '[' is one array (an invalid one is fatal), others are lines.

    ``shape`` "lines" or "array" says so for all files, which saves the look at their beginnings. Arrays are read by ranges
    of ``range_bytes``, whatever their size. Lines that aren't objects are left out, or with ``keep_malformed`` stay with null
    fields, which the parser rejects and counts.
    """
    if shape not in ("auto", "lines", "array"):
        raise LogIngestionError(f"unknown JSON shape: {shape}")
    arrays = None if shape == "lines" else _shapes(spark, path, shape).where("is_array")
    mixed, parts = shape == "auto" and bool(arrays.take(1)), []
    if shape != "array":
        lines, number = _lines(spark, path, line_numbers)
        meta = _meta("ndjson", F.col("__file"), line=number)
        if mixed:
            lines = lines.join(arrays.select(F.col("name").alias("__file")), "__file", "left_anti")
        parts.append(lines.select(_bare(F.col("value")).alias("value"), meta.alias("source_meta"), F.lit(True).alias("line")))
    if mixed or shape == "array":
        items = _array_items(spark, arrays, path, range_bytes)
        meta = _meta("json_array", F.col("name"), idx=F.col("idx"))
        parts.append(items.select(strip(F.col("value")).alias("value"), meta.alias("source_meta"), F.lit(False).alias("line")))
    rows = functools.reduce(DataFrame.unionByName, parts).where("value <> ''")
    fields = F.when(F.col("value").startswith("{"), F.from_json("value", "map<string,string>"))
    rows = rows.select(fields.alias("fields"), "source_meta", "line")
    return rows.where("fields IS NOT NULL OR line" if keep_malformed else "fields IS NOT NULL").drop("line")


def read_csv_logs(spark: SparkSession, path: str, delimiter: str = ",", line_numbers: bool = False) -> DataFrame:
    """fields, source_meta. The first line names the columns; a source without one is an error."""
    if _load(spark.read.text, path).limit(1).count() == 0:
        raise LogIngestionError(f"CSV source is empty: {path}")
    rows = spark.read.csv(
        path, header=True, sep=delimiter, multiLine=True, quote='"', escape='"', inferSchema=False, enforceSchema=False
    )
    names = {c: c.removeprefix(_BOM).strip() for c in rows.columns}
    pairs = [x for c, n in names.items() for x in (F.lit(n), F.col(f"`{c}`"))]
    filled = F.coalesce(*(F.col(f"`{c}`") for c in names)).isNotNull()
    rows = _placed(rows)
    rows, number = (_numbered(rows, 2), F.col("__line")) if line_numbers else (rows, None)
    return rows.where(filled).select(F.create_map(*pairs).alias("fields"), _meta("csv", F.col("__file"), line=number).alias("source_meta"))


def detect_format(path: str) -> str:
    """By the ending: .json, .csv, and text for everything else."""
    name = path.lower()
    return "json" if name.endswith(".json") else "csv" if name.endswith(".csv") else "text"


def read_logs(spark: SparkSession, path: str, fmt: str = "auto", **options) -> DataFrame:
    """Raw rows of a file or folder. Formats beyond text, json and csv are those of ``register_source``; their options go to the source."""
    readers = {"text": read_text_logs, "json": read_json_logs, "csv": read_csv_logs}
    fmt = detect_format(path) if fmt == "auto" else fmt
    if fmt in readers:
        return readers[fmt](spark, path, **options)
    if fmt not in FORMATS:
        raise LogIngestionError(f"unknown log format: {fmt}")
    try:
        rows = spark.read.format(fmt).options(**options).load(path)
        rows.rdd.getNumPartitions()  # the source lists its files when Spark plans the scan
    except Exception as error:
        if "log source not found" in str(error):
            raise LogIngestionError(f"log source not found: {path}") from error
        raise
    return rows


#: Input of at most so many bytes is spread.
SPREAD_BYTES = 256 << 20


def spread(df: DataFrame, most: int = SPREAD_BYTES) -> DataFrame:
    """``df`` dealt evenly over the cores, if it is small by Spark's estimate and has fewer partitions than there are cores.

    A small file is one partition, whatever its rows cost later. Beyond ``most`` bytes nothing is shuffled: the scan's own
    partitions (``spark.sql.files.maxPartitionBytes``) decide, however many cores there are.
    """
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    if int(str(size)) > most:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def from_dataframe(df: DataFrame, mapping: Mapping[str, Column | str]) -> DataFrame:
    """A parsed or canonical log table from any DataFrame: target column -> source column or expression."""
    return df.select(*((F.expr(c) if isinstance(c, str) else c).alias(name) for name, c in mapping.items()))
