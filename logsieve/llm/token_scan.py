"""Token counts of flat token files without an index, by scanning for separators.

A file is a bare run of token ids; an end-of-document id closes each document.
Files are cut into blocks wherever it suits the reader. Each block is searched
for separators in one vectorised comparison, which yields its documents' inner
lengths and a summary (tokens, separators, last separator). A prefix scan over the
summaries stitches documents that cross block borders: sums and maxima within
groups of ``GROUP`` blocks, then over the groups, so that no window holds more than
``GROUP`` blocks, or one row for each group of a file.

Defined results: an empty document counts 0 tokens. Ids after a file's last
separator are an unfinished document (``complete`` false). Empty files and empty
tables give no rows. Equal files are counted separately by their names. Null texts count as empty, null ids
stay null, repeated rows are counted each; very long texts span as many blocks as they need. Columns beyond id
and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ..workers import importable
from .runtime import durable, table
from .tokens import blocks as text_blocks
from .tokens import encoder, tokenizer_path

GROUP = 1024
#: The end-of-document id of the byte-level vocabulary.
END_ID = 50256
BLOCK_TOKENS = 1 << 16

_LIGHT = (
    "shard string, block bigint, total bigint, ends bigint, last_end bigint, lengths array<bigint>, "
    "ordinal bigint, doc_id bigint"
)


def id_type(tokenizer: str | None = None, end_id: int = END_ID) -> str:
    """The narrowest kind of id that holds a tokenizer's vocabulary and the separator: two bytes, or four."""
    size = Tokenizer.from_file(tokenizer or tokenizer_path()).get_vocab_size()
    return "<u2" if max(size - 1, end_id) < 1 << 16 else "<u4"


def read_token_files(
    spark: SparkSession, path: str, block_bytes: int = 1 << 20, range_bytes: int = 16 << 20, dtype: str = "<u2"
) -> DataFrame:
    """(shard, block, data) of flat files of any size.

    Spark lists the files (names and lengths, no content); tasks of about eight ranges of ``range_bytes`` read them where
    they lie, through the file system that Arrow knows for the path's scheme, one block at a time. A task that is run
    again reads its ranges again. A file that became shorter, or has half an id at its end, fails.
    """
    if block_bytes < 1 or block_bytes % np.dtype(dtype).itemsize:
        raise ValueError("blocks must hold whole token ids")
    importable(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    total = files.agg(F.sum("length")).first()[0] or 0
    per_range = max(1, range_bytes // block_bytes)
    n = F.ceil(F.col("length") / block_bytes).cast("long")
    first = F.explode(F.sequence(F.lit(0).cast("long"), n - 1, F.lit(per_range).cast("long"))).alias("first")
    ranges = files.select("path", "length", first).repartition(max(1, -(-total // (8 * range_bytes))), "path", "first")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, length, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, inner = _file_system(name)
                with system.open_input_file(inner) as file:
                    for block in range(at, min(at + per_range, -(-length // block_bytes))):
                        size = min(block_bytes, length - block * block_bytes)
                        data = file.read_at(size, block * block_bytes)
                        if len(data) != size:
                            raise OSError(f"{name} became shorter while it was read")
                        yield pa.RecordBatch.from_pydict({"shard": [name], "block": [block], "data": [data]})

    return ranges.mapInArrow(work, "shard string, block bigint, data binary")


def _file_system(name: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as Spark lists it, and the path inside; ``file:/a`` means a local file."""
    if name.startswith("file:"):
        return fs.LocalFileSystem(), "/" + name.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(name)


def _summary(data: bytes, dtype: str, end_id: int) -> tuple[int, int, int | None, list[int]]:
    """(tokens, separators, tokens up to the last separator, lengths of what they close)."""
    ids = np.frombuffer(data, dtype)
    at = np.flatnonzero(ids == end_id)
    lengths = np.diff(at, prepend=-1) - 1
    return len(ids), len(at), int(at[-1]) + 1 if len(at) else None, lengths.tolist()


def scan_blocks(blocks: DataFrame, dtype: str = "<u2", end_id: int = END_ID) -> DataFrame:
    """A light row for each block; the first length lacks what earlier blocks hold of that document.

    Rows without ``data`` pass through, if the table has ``ordinal`` and ``doc_id``.
    """
    importable(blocks.sparkSession)
    carry = [c if c in blocks.columns else F.lit(None).cast("bigint").alias(c) for c in ("ordinal", "doc_id")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (None, None, None, None) if d is None else _summary(d.as_buffer(), dtype, end_id)
                for d in (x if x.is_valid else None for x in batch.column(2))
            ]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    *(pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)),
                    batch.column(3),
                    batch.column(4),
                ],
                names=["shard", "block", "total", "ends", "last_end", "lengths", "ordinal", "doc_id"],
            )

    return blocks.select("shard", "block", "data", *carry).mapInArrow(work, _LIGHT)


def stitch(light: DataFrame, group: int = GROUP) -> DataFrame:
    """(shard, ordinal, n_tokens, complete) of every document, from the blocks' light rows."""
    rows = light.withColumn("group", F.floor(F.col("block") / group))
    inside = Window.partitionBy("shard", "group").orderBy("block")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns(
        {
            "p1": F.coalesce(F.sum("total").over(before), F.lit(0)),
            "n1": F.coalesce(F.sum("ends").over(before), F.lit(0)),
        }
    )
    rows = rows.withColumn("e1", F.max(F.col("p1") + F.col("last_end")).over(before))
    groups = rows.groupBy("shard", "group").agg(
        F.sum("total").alias("t"), F.sum("ends").alias("n"), F.max(F.col("p1") + F.col("last_end")).alias("e")
    )
    earlier = Window.partitionBy("shard").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumns(
        {
            "p2": F.coalesce(F.sum("t").over(earlier), F.lit(0)),
            "n2": F.coalesce(F.sum("n").over(earlier), F.lit(0)),
            "last": F.max("group").over(Window.partitionBy("shard")),
        }
    ).withColumn("e2", F.max(F.col("p2") + F.col("e")).over(earlier))
    rows = rows.join(groups.select("shard", "group", "p2", "n2", "e2", "last"), ["shard", "group"])
    held = F.col("p2") + F.col("p1") - F.coalesce(F.col("p2") + F.col("e1"), "e2", F.lit(0))
    rows = rows.withColumns(
        {
            "held": held,
            "first": F.col("n2") + F.col("n1"),
            "final": (F.col("group") == F.col("last"))
            & (F.col("block") == F.max("block").over(Window.partitionBy("shard", "group"))),
        }
    )
    whole = F.transform(
        "lengths",
        lambda x, i: F.struct(
            (F.col("first") + i).alias("ordinal"),
            (x + F.when(i == 0, F.col("held")).otherwise(0)).alias("n_tokens"),
            F.lit(True).alias("complete"),
        ),
    )
    open_tokens = F.col("total") - F.coalesce("last_end", F.lit(0)) + F.when(F.col("ends") == 0, F.col("held")).otherwise(0)
    rest = F.when(
        F.col("final") & (open_tokens > 0),
        F.array(
            F.struct(
                (F.col("first") + F.col("ends")).alias("ordinal"),
                open_tokens.alias("n_tokens"),
                F.lit(False).alias("complete"),
            )
        ),
    ).otherwise(F.array().cast("array<struct<ordinal:bigint,n_tokens:bigint,complete:boolean>>"))
    out = rows.select("shard", F.explode(F.concat(whole, rest)).alias("d"))
    return out.select("shard", "d.ordinal", "d.n_tokens", "d.complete")


def count_tokens(blocks: DataFrame, dtype: str = "<u2", end_id: int = END_ID) -> DataFrame:
    """(shard, ordinal, n_tokens, complete) of (shard, block, data)."""
    return stitch(durable(scan_blocks(blocks, dtype, end_id)))


def token_shards(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    end_id: int = END_ID,
    block_tokens: int = BLOCK_TOKENS,
    dtype: str | None = None,
) -> DataFrame:
    """Flat token shards of documents: rows (shard, block, data), and rows (shard, ordinal, doc_id)
    that name the documents in their order. One shard for each partition of ``docs``.

    Ids are as wide as the vocabulary asks (``id_type``) unless ``dtype`` says so; one that doesn't fit fails.
    """
    importable(docs.sparkSession)
    path = tokenizer or tokenizer_path()
    dtype = dtype or id_type(path, end_id)
    names = ["shard", "block", "data", "ordinal", "doc_id"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, ordinary=True).encode  # the separator must not occur in a text
        shard, block, seen, kept = f"shard-{TaskContext.get().partitionId():05d}", 0, 0, b""
        size, most = np.dtype(dtype).itemsize * block_tokens, np.iinfo(dtype).max

        def blocks_row(data: bytes, number: int) -> pa.RecordBatch:
            none = pa.nulls(1, pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array([shard]), pa.array([number]), pa.array([data], pa.binary()), none, none], names=names
            )

        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([shard] * n, pa.string()),
                    pa.nulls(n, pa.int64()),
                    pa.nulls(n, pa.binary()),
                    pa.array(np.arange(seen, seen + n)),
                    batch.column(0).cast(pa.int64()),
                ],
                names=names,
            )
            seen += n
            for texts in text_blocks(batch.column(1).fill_null("")):
                ids, bounds = encode(texts)
                bounds = bounds + np.arange(len(bounds))
                if len(ids) and int(ids.max()) > most or end_id > most:
                    raise ValueError(f"an id exceeds {most}, the most that {dtype} holds")
                out = np.full(bounds[-1], end_id, dtype)
                keep = np.ones(bounds[-1], bool)
                keep[bounds[1:] - 1] = False
                out[keep] = ids
                data, at = memoryview(kept + out.tobytes()), 0
                while len(data) - at >= size:
                    yield blocks_row(bytes(data[at : at + size]), block)
                    at, block = at + size, block + 1
                kept = bytes(data[at:])
        if kept:
            yield blocks_row(kept, block)

    schema = "shard string, block bigint, data binary, ordinal bigint, doc_id bigint"
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(work, schema)


def op5_separator_scan(spark, sf_dir):
    """Token counts of all documents, read back from the flat shards that hold them."""
    dtype = id_type()
    light = durable(scan_blocks(token_shards(table(spark, sf_dir, "documents"), dtype=dtype), dtype))
    counts = stitch(light.where("block is not null").select("shard", "block", "total", "ends", "last_end", "lengths"))
    named = light.where("block is null").select("shard", "ordinal", "doc_id")
    return named.join(counts, ["shard", "ordinal"]).select("doc_id", "n_tokens")
