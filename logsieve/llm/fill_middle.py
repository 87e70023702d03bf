"""Fill-in-the-middle transformation by an index of distinct texts.

Documents are grouped by their content: rows of one digest meet, and texts are one only if all of
their bytes agree, so that each distinct text is in the index once. Documents are joined back by digest. For each text of the index the
list of its code points' byte offsets is computed once, as Elias-Fano list (the high bits of the offsets in
unary, the low ones packed: about two bits a code point, with constant-time access to any offset by
a directory of set bits), and every document of the text selects its two seeded cuts from it.

Texts are shuffled once; the documents' side of the join has ids and digests only. Digests that could fill a task alone (counted
exactly, at most ``4 * partitions``) take another way: their texts are made distinct before the shuffle, and
are joined to their documents by digest and salt.

Defined results: a null text is an empty one, and empty texts are plain. A null id is seeded as if its
decimal form were empty. Rows of one id have the same seeds, so repeated rows get the same result. A text that holds a sentinel is
plain. If both cuts are equal the middle is empty. Very long texts are cut whole. Other columns aren't read, whatever their names. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..workers import importable
from .runtime import durable, shuffle_partitions, table, tidy

# The sentinels before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of results that a task holds.
_HELD = 4_000_000


@dataclass(frozen=True)
class FillMiddle:
    """Parameters: seed, documents in a hundred that are cut, and of those that are cut the ones with the suffix first."""

    seed: int = 1
    cut_percent: int = 90
    spm_percent: int = 20
    #: Rows of a digest from which it may be too many for a task.
    hot_rows: int = 2000


# --- boundary lists -------------------------------------------------------------------------------------------------


class EliasFano:
    """A rising list of numbers below ``bound``, in about 2 + log2(bound / n) bits each."""

    def __init__(self, values: np.ndarray, bound: int):
        self.n = n = len(values)
        self.low_bits = max(0, (bound // n).bit_length() - 1) if n else 0
        if not n:
            return
        high = (values >> self.low_bits) + np.arange(n)
        marks = np.zeros(-(-(int(high[-1]) + 1) // 64) * 64, np.uint8)
        marks[high] = 1
        self.words = np.packbits(marks, bitorder="little").view("<u8")
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))
        low = (values & ((1 << self.low_bits) - 1)).astype("<u8")
        bits = np.unpackbits(low.view(np.uint8), bitorder="little").reshape(n, 64)[:, : self.low_bits]
        self.low = np.packbits(bits.ravel(), bitorder="little")

    def select(self, i: int) -> int:
        """The number at place ``i``."""
        word = int(np.searchsorted(self.before, i, side="right")) - 1
        left, bits = i - int(self.before[word]), int(self.words[word])
        for _ in range(left):
            bits &= bits - 1
        high = 64 * word + (bits & -bits).bit_length() - 1 - i
        at = i * self.low_bits
        held = int.from_bytes(self.low[at // 8 : (at + self.low_bits + 7) // 8].tobytes(), "little")
        return high << self.low_bits | held >> at % 8 & (1 << self.low_bits) - 1


class Boundaries:
    """Byte offsets of the code points of a UTF-8 text."""

    def __init__(self, text: bytes):
        starts = np.flatnonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
        self.size, self.n = len(text), len(starts)
        self.list = EliasFano(starts, self.size)

    def offset(self, i: int) -> int:
        return self.size if i == self.n else self.list.select(i)


def arrange(text: bytes, bounds: Boundaries, one: int, two: int, form: str) -> bytes:
    """The text in ``form`` (psm or spm) with its middle between the code points ``one`` and ``two``."""
    a, z = bounds.offset(one), bounds.offset(two)
    prefix, middle, suffix = text[:a], text[a:z], text[z:]
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
    return b"".join((p, prefix, s, suffix, m, middle) if form == "psm" else (s, suffix, p, prefix, m, middle))


# --- documents ------------------------------------------------------------------------------------------------------


def _draw(group: int, seed: int) -> Column:
    """Whole number of the ``group``-th eight hexadecimal digits of the row's seeded digest."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * group - 7, 8), 16, 10).cast("bigint")


def _index(texts: DataFrame) -> DataFrame:
    """Each distinct text once, compared whole; stays partitioned as ``texts`` are."""
    return texts.groupBy(*texts.columns).agg(F.count(F.lit(1)).alias("copies"))


def fill_in_middle(docs: DataFrame, config: FillMiddle = FillMiddle(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n, form, prefix_chars, middle_chars, output and text_sha256 (of the document's text) of each row."""
    spark = docs.sparkSession
    importable(spark)
    n = shuffle_partitions(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.sha2(text, 256).alias("digest"))
    light = durable(rows.select("id", "digest"))
    counts = durable(light.groupBy("digest").count().where(F.col("count") >= config.hot_rows))
    hot: list = []
    if counts.take(1):
        least = max(config.hot_rows, light.count() // (4 * n))
        hot = counts.where(F.col("count") >= least).orderBy(F.desc("count")).limit(4 * n).collect()
    names = [r["digest"] for r in hot]
    is_hot = F.col("digest").isin(names) if names else F.lit(False)
    # Partitioned by digest before the texts are grouped, so that the join needs no other shuffle of texts.
    index = _index(rows.where(~is_hot).select("digest", "text").repartition("digest"))
    joined = index.join(light.where(~is_hot), "digest").select("digest", "text", "id")
    found = _cut(joined, config)
    if names:
        salts = max(r["count"] for r in hot) // config.hot_rows + 1
        salt = F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(salts)).alias("salt")
        few = _index(rows.where(is_hot).select("digest", "text"))  # distinct before the shuffle
        few = few.select("digest", "text", F.explode(F.expr(f"sequence(0L, {salts - 1}L)")).alias("salt"))
        many = light.where(is_hot).select("id", "digest", salt)
        found = found.unionByName(_cut(few.join(many, ["digest", "salt"]).select("digest", "text", "id"), config))
    chars = lambda c: F.when(F.col("form") != "plain", F.col(c))
    return found.select(
        F.col("id").alias(id_col), "n", "form", chars("prefix_chars").alias("prefix_chars"), chars("middle_chars").alias("middle_chars"),
        "output", F.col("digest").alias("text_sha256"),
    )


def _cut(joined: DataFrame, config: FillMiddle) -> DataFrame:
    """The cuts of rows (digest, text, id); rows of one digest stand together."""
    draws = joined.select("*", *(_draw(i, config.seed).alias(f"h{i}") for i in (1, 2, 3, 4)))
    marked = F.lit(False)
    for sentinel in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains("text", F.lit(sentinel))
    plain = (F.col("text") == "") | marked | (F.col("h3") % 100 >= config.cut_percent)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < config.spm_percent, "spm").otherwise("psm")
    rows = draws.select("id", "digest", "text", "h1", "h2", form.alias("form")).sortWithinPartitions("digest")
    schema = "id " + joined.schema["id"].dataType.simpleString() + ", digest string, form string, n bigint, prefix_chars bigint, middle_chars bigint, output string"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, text, bounds = None, b"", None
        for batch in batches:
            held: list[list] = [[], [], [], []]
            size = first = 0
            for i, (digest, h1, h2, form) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("digest", "h1", "h2", "form")), strict=True)):
                if digest != last:
                    last, text = digest, batch.column("text")[i].as_buffer().to_pybytes()
                    bounds = Boundaries(text)
                one, two = sorted((h1 % (bounds.n + 1), h2 % (bounds.n + 1)))
                output = text if form == "plain" else arrange(text, bounds, one, two, form)
                for column, value in zip(held, (bounds.n, one, two - one, output), strict=True):
                    column.append(value)
                size += len(output)
                if size > _HELD or i == batch.num_rows - 1:
                    part = batch.slice(first, i + 1 - first)
                    counts = [pa.array(column, pa.int64()) for column in held[:3]]
                    output = pa.array(held[3], pa.binary()).cast(pa.string())
                    yield pa.RecordBatch.from_arrays(
                        [*(part.column(c) for c in ("id", "digest", "form")), *counts, output],
                        names=["id", "digest", "form", "n", "prefix_chars", "middle_chars", "output"],
                    )
                    held, size, first = [[], [], [], []], 0, i + 1

    return rows.mapInArrow(tidy(work), schema)


def restored(output: Column, form: Column) -> Column:
    """The exact text of an output: no text that was cut holds a sentinel, so each stands in its output once."""
    before = lambda c, mark: F.split_part(c, F.lit(mark), F.lit(1))
    after = lambda c, mark: F.split_part(c, F.lit(mark), F.lit(2))
    psm = F.concat(after(before(output, SUFFIX), PREFIX), after(output, MIDDLE), after(before(output, MIDDLE), SUFFIX))
    spm = F.concat(after(before(output, MIDDLE), PREFIX), after(output, MIDDLE), after(before(output, PREFIX), SUFFIX))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def op13_distinct_text_cuts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = fill_in_middle(docs)
    return rows.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def oracle(config: FillMiddle = FillMiddle()) -> str:
    """DuckDB SQL of the query's rows."""
    h = lambda i: f"CAST('0x' || substr(d, {8 * i - 7}, 8) AS BIGINT)"
    marked = " OR ".join(f"contains(t, '{s}')" for s in (PREFIX, SUFFIX, MIDDLE))
    pieces = "substr(t, 1, a) AS p, substr(t, a + 1, z - a) AS m, substr(t, z + 1) AS s"
    return f"""
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN z - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m
              ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM (SELECT *, {pieces},
        CASE WHEN n = 0 OR {marked} OR h3 % 100 >= {config.cut_percent} THEN 'plain' WHEN h4 % 100 < {config.spm_percent} THEN 'spm' ELSE 'psm' END AS form
      FROM (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS z
            FROM (SELECT doc_id, t, n, {h(1)} AS h1, {h(2)} AS h2, {h(3)} AS h3, {h(4)} AS h4
                  FROM (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
                               sha256('{config.seed}:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents))))"""


ORACLE = oracle()
