"""Exact duplicates by sorting content.

Sampled splitters range-partition the normalised bytes (Spark's range exchange
on their leading bytes and a 64-bit hash, so that the sampled keys stay short),
the external sort of each range places equal texts next to one another, and the
window compares whole neighbouring texts. Whole texts are shuffled once.

Hot groups: a sample finds the few hashes that alone could fill a partition
(at most ``4 * partitions`` by construction). Their rows get a salt, so that a
group spreads over many ranges; the totals of these few texts are
pre-aggregated before their shuffle and joined back as a table of bounded size.
The sample only steers where rows go; every row is sorted and compared.

Defined results: null text counts as empty, empty texts form one group; very long texts are compared whole. Of
rows that repeat both text and id exactly one is kept. A row without an id stays only if no row of its text has one, and then
one of them does, with a null ``keep_id``. Columns are those of
the input plus ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``
(which replace columns of those names); an empty table gives an empty result.
DataFrame functions only: no Python on the executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import LOWER, UPPER, ascii_lower, shuffle_partitions, table

#: Rows looked at to find texts that need a salt; bounds the driver's work.
HOT_SAMPLE_ROWS = 200_000
#: Leading characters of the range key.
KEY_CHARS = 24


def _hot_hashes(keyed: DataFrame, partitions: int, rows: int) -> list[int]:
    """Hashes that hold over 1 / (4 * partitions) of a sample, at most 4 * partitions of them."""
    sample = keyed.select("__h")
    if rows > HOT_SAMPLE_ROWS:
        sample = sample.sample(HOT_SAMPLE_ROWS / rows, seed=17)
    seen = min(rows, HOT_SAMPLE_ROWS)
    least = max(16, seen // (4 * partitions))
    found = sample.groupBy("__h").count().where(F.col("count") >= least)
    return [r["__h"] for r in found.select("__h").take(4 * partitions)]


def sort_content(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    partitions: int | None = None,
) -> DataFrame:
    """Every row of ``docs`` with its group's surviving id, size and digest."""
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be 'smallest' or 'largest', not {keep!r}")
    docs = docs.drop("keep_id", "group_size", "kept", "text_sha256")
    n = partitions or shuffle_partitions(docs.sparkSession)
    best = F.max if keep == "largest" else F.min
    text = F.coalesce(F.col(text_col), F.lit(""))
    # lower() folds more letters than the normal form does, so equal normal forms have equal keys.
    keyed = docs.withColumn("__h", F.xxhash64(F.lower(text)))
    hot = _hot_hashes(keyed, n, docs.count())
    salt = F.pmod(F.xxhash64(id_col), F.lit(n)).cast("int")
    keyed = keyed.withColumn("__p", F.substring(F.lower(text), 1, KEY_CHARS))
    keys = ["__p", "__h"]
    if hot:
        keyed = keyed.withColumn("__s", F.when(F.col("__h").isin(hot), salt).otherwise(F.lit(-1)))
        keys.append("__s")
    norm = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    ranged = keyed.repartitionByRange(n, *keys).withColumn("__norm", norm)
    # The range exchange already clusters these keys, so the window adds a sort but no exchange.
    order = F.col(id_col).desc_nulls_last() if keep == "largest" else F.col(id_col).asc_nulls_last()
    run = Window.partitionBy(*keys, "__norm").orderBy(order)
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sorted_rows = ranged.select(
        *docs.columns,
        best(id_col).over(whole).alias("keep_id"),
        F.count(F.lit(1)).over(whole).alias("group_size"),
        F.row_number().over(run).alias("__rn"),
        F.sha2("__norm", 256).alias("text_sha256"),
    )
    if hot:
        totals = (
            keyed.where(F.col("__s") >= 0)
            .groupBy(norm.alias("__norm"))
            .agg(best(id_col).alias("__keep"), F.count(F.lit(1)).alias("__n"))
            .select(F.sha2("__norm", 256).alias("text_sha256"), "__keep", "__n")
        )
        # At most one row for each hot hash (and text that shares it): size bounded by 4 * partitions.
        sorted_rows = sorted_rows.join(F.broadcast(totals), "text_sha256", "left")
        keep_id, size = F.coalesce("__keep", "keep_id"), F.coalesce("__n", "group_size")
    else:
        keep_id, size = F.col("keep_id"), F.col("group_size")
    return sorted_rows.select(
        *docs.columns,
        keep_id.alias("keep_id"),
        size.alias("group_size"),
        ((F.col("__rn") == 1) & F.col(id_col).eqNullSafe(keep_id)).alias("kept"),
        "text_sha256",
    )


def op6_content_sort(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sort_content(docs, keep="largest").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = f"""
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
       sha256(norm) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS norm FROM documents)
WINDOW g AS (PARTITION BY norm)"""
