"""Vector best-fit packing of documents into training sequences.

Each open sequence has three residual capacities: tokens, documents and
attention cost (the sum of squared piece lengths). Pieces go in decreasing
length to the feasible sequence with the smallest weighted norm of what would
remain, or the largest weighted dot product of residual and demand; if none is
feasible a new sequence opens. Every capacity holds at every step.

Tokenising and a first packing happen in one pass over each partition. The pieces
of all sequences that this doesn't fill are then packed again, from all
partitions together, in partitions of about ``REPACKED`` pieces, so the result
doesn't depend on how the rows were dealt. Only light rows (id, piece, start,
length, checksum; the ids only if asked for) are checkpointed and shuffled. Sequence numbers
carry the pass and the partition's number, so they are unique.

Defined results: null text counts as empty (the end id alone); repeated rows
are packed once each; an empty table gives no rows. Very long texts are cut, in whole pieces but the first. Of
sequences that fit equally well the one opened first is taken. Columns beyond id and text
are not read. Strings of special tokens in a text are those tokens, as the tokenizer reads them.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..workers import importable
from .runtime import durable, table, tidy
from .tokens import blocks, encoder, tokenizer_path

#: Pieces in one partition of the second pass.
REPACKED = 50_000


@dataclass(frozen=True)
class Capacity:
    """Limits of one sequence and the weights of (tokens, documents, cost) in the choice."""

    tokens: int = 1024
    documents: int = 1024
    cost: int = 1024 * 1024
    weights: tuple[float, float, float] = (1.0, 1e-4, 1e-4)
    choose: str = "norm"  # or "dot"


@dataclass
class _Pieces:
    rows: list[np.ndarray] = field(default_factory=list)

    def add(self, row: np.ndarray, piece: np.ndarray, start: np.ndarray, length: np.ndarray, crc: np.ndarray) -> None:
        self.rows.append(np.stack([row, piece, start, length, crc]))


def best_fit(lengths: np.ndarray, cap: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each length; longer pieces are placed first.

    Pieces of one length are placed together: the open sequences are scored once for each distinct length, of which there are no
    more than a sequence has tokens, and a heap has those that took a piece and can take another. Time is in proportion to the pieces.
    """
    if cap.documents < 1 or (len(lengths) and (lengths.max() > cap.tokens or int(lengths.max()) ** 2 > cap.cost)):
        raise ValueError("a piece exceeds the capacity of an empty sequence")
    limits = (cap.tokens, cap.documents, cap.cost)
    weights = [w / limit**2 for w, limit in zip(cap.weights, limits, strict=True)]
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    order = np.argsort(-lengths, kind="stable")
    smallest = int(lengths.min()) if len(lengths) else 0
    residual, number = np.empty((3, 0)), np.empty(0, np.int64)  # of open sequences
    total = 0
    for group in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if len(order) else ():
        size = int(lengths[group[0]])
        demand = (size, 1, size * size)

        def score(has):
            if cap.choose == "norm":
                return sum(w * (r - d) ** 2 for w, r, d in zip(weights, has, demand, strict=True))  # noqa: B023
            return -sum(w * r * d for w, r, d in zip(weights, has, demand, strict=True))  # noqa: B023

        fits = np.flatnonzero(residual[0] >= size)
        fits = fits[(residual[1, fits] >= 1) & (residual[2, fits] >= size * size)]
        scores = score(residual[:, fits])
        if len(fits) > len(group):  # no more than one each can be needed
            best = scores <= np.partition(scores, len(group) - 1)[len(group) - 1]
            fits, scores = fits[best], scores[best]
        ranked = np.lexsort((number[fits], scores))[: len(group)]
        queue = list(zip(scores[ranked].tolist(), number[fits[ranked]].tolist(), fits[ranked].tolist(), strict=True))
        left = {slot: tuple(residual[:, slot].tolist()) for _, _, slot in queue}
        again: list[tuple] = []
        at, opened = 0, residual.shape[1]
        for i in group.tolist():
            if at < len(queue) and (not again or queue[at] <= again[0]):
                _, name, slot = queue[at]
                at += 1
            elif again:
                _, name, slot = heapq.heappop(again)
            else:
                name, slot, total, opened = total, opened, total + 1, opened + 1
                left[slot] = limits
            has = left[slot]
            where[i], offset[i] = name, cap.tokens - has[0]
            left[slot] = has = tuple(r - d for r, d in zip(has, demand, strict=True))
            if all(r >= d for r, d in zip(has, demand, strict=True)):
                heapq.heappush(again, (score(has), name, slot))
        more = opened - residual.shape[1]
        residual = np.concatenate([residual, np.empty((3, more))], axis=1)
        number = np.concatenate([number, np.arange(total - more, total)])
        slots = np.fromiter(left, np.int64, len(left))
        residual[:, slots] = np.array([*left.values()], float).reshape(-1, 3).T
        # Full sequences are closed.
        kept = (residual >= np.array([smallest, 1, smallest * smallest])[:, None]).all(axis=0)
        residual, number = residual[:, kept], number[kept]
    return where, offset


def cut(n_ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, piece, start, length): texts over ``most`` ids in pieces of ``most``, the first takes the rest."""
    n_pieces = -(-n_ids // most)
    row = np.repeat(np.arange(len(n_ids)), n_pieces)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
    first = n_ids - (n_pieces - 1) * most
    start = np.where(piece == 0, 0, first[row] + (piece - 1) * most)
    return row, piece, start, np.where(piece == 0, first[row], most)


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    end_id: int = 2,
    cap: Capacity = Capacity(),
    with_ids: bool = False,
) -> DataFrame:
    """A row for each piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    ``with_ids`` adds the piece's ids (array<int>), to write the sequences themselves.
    """
    importable(docs.sparkSession)
    path = tokenizer or tokenizer_path()
    id_field = docs.schema[id_col]
    long = T.LongType()
    schema = T.StructType(
        [
            T.StructField(id_col, id_field.dataType),
            T.StructField("piece", T.IntegerType()),
            T.StructField("start", long),
            T.StructField("length", long),
            T.StructField("ids_crc32", long),
            T.StructField("sequence_id", long),
            T.StructField("offset", long),
            T.StructField("filled", long),
        ]
        + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        keys, kept, pieces, seen = [], [], _Pieces(), 0
        for batch in batches:
            keys.append(batch.column(0))
            for texts in blocks(batch.column(1).fill_null("")):
                ids, bounds = encode(texts)
                bounds = bounds + np.arange(len(bounds))  # an end id after each text
                out = np.full(bounds[-1], end_id, np.uint32)
                keep = np.ones(bounds[-1], bool)
                keep[bounds[1:] - 1] = False
                out[keep] = ids
                row, piece, start, length = cut(np.diff(bounds), cap.tokens)
                at = bounds[:-1][row] + start
                view = memoryview(out.astype("<u4", copy=False)).cast("B")
                crc = [zlib.crc32(view[4 * a : 4 * z]) for a, z in zip(at.tolist(), (at + length).tolist(), strict=True)]
                pieces.add(row + seen, piece, start, length, np.array(crc, np.int64))
                if with_ids:
                    kept += [out[a:z].astype(np.int32) for a, z in zip(at, at + length, strict=True)]
                seen += len(texts)
        if not seen:
            return
        row, piece, start, length, crc = np.concatenate(pieces.rows, axis=1)
        where, offset = best_fit(length, cap)
        filled = np.bincount(where, length).astype(np.int64)[where]
        where += TaskContext.get().partitionId() << 33
        ids_of = pa.chunked_array(keys).combine_chunks()
        for a in range(0, len(row), 10_000):
            part = slice(a, a + 10_000)
            columns = [
                ids_of.take(pa.array(row[part])),
                pa.array(piece[part].astype(np.int32)),
                *(pa.array(x[part]) for x in (start, length, crc, where, offset, filled)),
            ]
            if with_ids:
                columns.append(pa.array(kept[part], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])

    def repack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        where, offset = best_fit(rows["length"].to_numpy(), cap)
        where += ((1 << 29) + TaskContext.get().partitionId()) << 33
        for name, values in (("sequence_id", where), ("offset", offset)):
            rows = rows.set_column(rows.schema.get_field_index(name), name, pa.array(values))
        yield from rows.to_batches(10_000)

    packed = durable(docs.select(id_col, text_col).mapInArrow(tidy(pack), schema))
    full = F.col("filled") == cap.tokens
    loose = packed.where(~full)
    n_loose = loose.count()
    if n_loose:
        again = loose.repartition(-(-n_loose // REPACKED)).mapInArrow(tidy(repack), schema)
        packed = packed.where(full).unionByName(again)
    return packed.drop("filled")


def op10_best_fit_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"))
