"""Byte-level BPE over Arrow string columns, equal to the tokenizer file id by id.

The pre-tokeniser's split (contractions, letters, numbers, other signs, blanks)
is computed for a whole buffer of UTF-8 bytes with numpy, Arrow's dictionary
finds the distinct pieces, and only pieces that this worker hasn't seen go
through the tokenizer itself. Texts with code points from U+3000 upwards, whose
classes change between Unicode versions, go through the tokenizer as a whole; so do texts that hold the
string of a special token, which is one id unless the caller asks for ``ordinary`` text.

Bounded memory: buffers of at most ``BLOCK_BYTES`` (or one text), and a memo of
at most ``MEMO_ENTRIES`` pieces and those of one buffer. A full memo keeps the pieces that more
than one buffer held, at most half of its entries; what it forgets is tokenised again.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from .runtime import give_back

BLOCK_BYTES = 1 << 20
MEMO_ENTRIES = 300_000
#: Longer pieces aren't kept in the memo.
MEMO_BYTES = 48
_TABLE = 0x3000
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)
# The code points below U+3000 that Unicode calls white space.
_BLANKS = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F)
# Endings that follow an apostrophe as one piece.
_ENDINGS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(1)
def _classes() -> np.ndarray:
    kinds = {"L": _LETTER, "N": _NUMBER}
    table = np.array([kinds.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(_TABLE)], np.uint8)
    table[list(_BLANKS)] = _SPACE
    return table


def blocks(texts: pa.Array, most: int = BLOCK_BYTES) -> Iterator[pa.Array]:
    """Slices of a string array of at most ``most`` bytes (or one row) each."""
    if len(texts) == 0:
        return
    ends = np.cumsum(pa.compute.binary_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield texts[at:to]
        at = to


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array without nulls."""
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1]
    offsets = offsets.astype(np.int64)
    bytes_ = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return bytes_[offsets[0] : offsets[-1]], offsets - offsets[0]


def split_points(b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start of every piece, texts to be tokenised whole) of a non-empty buffer."""
    table = np.zeros(256, np.uint8)
    table[:128] = _classes()[:128]
    kind = table[b]
    lead = np.flatnonzero(b >= 0xC0)
    odd = np.zeros(0, np.int64)
    if len(lead):
        first = b[lead].astype(np.int32)
        second = b[lead + 1].astype(np.int32) & 0x3F
        three = first >= 0xE0
        point = (first & 0x1F) << 6 | second
        at3 = lead[three]
        third = b[at3 + 2].astype(np.int32) & 0x3F
        point[three] = (first[three] & 0x0F) << 12 | second[three] << 6 | third
        point[first >= 0xF0] = _TABLE
        odd = lead[point >= _TABLE]
        found = _classes()[np.minimum(point, _TABLE - 1)]
        found[point >= _TABLE] = _OTHER
        kind[lead] = found
        kind[lead + 1] = found
        kind[at3 + 2] = found[three]
        at4 = lead[first >= 0xF0]
        kind[at4 + 3] = _OTHER
    opens = np.zeros(len(b) + 1, bool)  # where a text begins, and the end
    opens[offsets] = True
    new = np.empty(len(b), bool)
    new[0] = True
    np.not_equal(kind[1:], kind[:-1], out=new[1:])
    new |= opens[:-1]
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(b))
    # The last blank before other signs stands alone, and a plain space joins them.
    blank = (kind[start] == _SPACE) & ~opens[end]
    begun, done = start[blank], end[blank]
    last = done - 1
    wide = b[last] >= 0x80
    if wide.any():
        w = last[wide]
        last[wide] = np.where(b[w - 1] >= 0xC0, w - 1, w - 2)
    new[last[last > begun]] = True
    new[done[b[last] == 0x20]] = False
    # Contractions: an apostrophe that begins a piece takes the ending with it.
    mark = np.flatnonzero((b[:-1] == 0x27) & new[:-1] & (kind[1:] == _LETTER) & new[1:] & ~opens[1:-1])
    for p in mark:
        tail = b[p + 1 : p + 3].tobytes()
        for ending in _ENDINGS:
            if tail.startswith(ending) and not opens[p + 2 : p + 1 + len(ending)].any():
                new[p + 1] = False
                q = p + 1 + len(ending)
                if q < len(b):
                    new[q] = True
                break
    odd_texts = np.unique(np.searchsorted(offsets, odd, side="right") - 1) if len(odd) else odd
    return np.flatnonzero(new), odd_texts


class Encoder:
    """Ids of string columns. One per worker process; see ``encoder``.

    ``ordinary``: strings of special tokens are text like any other, so their ids never occur.
    """

    def __init__(self, path: str, ordinary: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.merger = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens, self.merger.encode_special_tokens = ordinary, True
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.whole = () if ordinary else tuple(t.content for t in added if t.content)
        # Pieces are already split, so only bytes are mapped before the merges.
        self.merger.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self._reset()

    def _reset(self) -> None:
        self.slots: dict[bytes, int] = {}
        self.pool = np.zeros(1 << 16, np.int32)
        self.begin = np.zeros(1 << 16, np.int64)
        self.size = np.zeros(1 << 16, np.int64)
        self.uses = np.zeros(1 << 16, np.int32)  # buffers that held the piece
        self.n = self.used = 0

    def _forget(self) -> None:
        """Keeps the pieces of several buffers, the most used ones first, and counts their uses as half as many."""
        held = np.fromiter(self.slots.values(), np.int64, len(self.slots))
        held = held[self.uses[held] > 1]
        if len(held) > MEMO_ENTRIES // 2:
            held = held[np.argsort(-self.uses[held], kind="stable")[: MEMO_ENTRIES // 2]]
        place = np.full(self.n, -1, np.int64)
        place[held] = np.arange(len(held))
        slots = {piece: int(place[slot]) for piece, slot in self.slots.items() if place[slot] >= 0}
        size, uses, begin, pool = self.size[held], self.uses[held] >> 1, self.begin[held], self.pool
        ends = np.cumsum(size)
        ids = pool[np.repeat(begin - ends + size, size) + np.arange(size.sum())]
        self._reset()
        self.slots, self.n, self.used = slots, len(held), len(ids)
        self._grow(self.n, self.used)
        self.pool[: self.used], self.begin[: self.n], self.size[: self.n], self.uses[: self.n] = ids, ends - size, size, uses

    def _grow(self, n: int, used: int) -> None:
        while used > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while n > len(self.begin):
            self.begin, self.size, self.uses = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.size, self.uses))

    @staticmethod
    def _plain(tokenizer, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _add(self, pieces: list[bytes]) -> list[int]:
        slots = []
        for piece, ids in zip(pieces, self._plain(self.merger, [p.decode() for p in pieces]), strict=True):
            self._grow(self.n + 1, self.used + len(ids))
            self.pool[self.used : self.used + len(ids)] = ids
            self.begin[self.n], self.size[self.n] = self.used, len(ids)
            if len(piece) <= MEMO_BYTES:
                self.slots[piece] = self.n
            slots.append(self.n)
            self.used += len(ids)
            self.n += 1
        return slots

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, offsets of the texts in them) of a block without nulls."""
        b, offsets = raw(texts)
        if not len(b):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        if self.n > MEMO_ENTRIES:
            self._forget()
        start, odd = split_points(b, offsets)
        for mark in self.whole:
            held = pa.compute.match_substring(texts, mark).to_numpy(zero_copy_only=False)
            odd = np.union1d(odd, np.flatnonzero(held)).astype(np.int64)
        limits = np.append(start, len(b)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(limits), pa.py_buffer(b)])
        coded = pieces.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        known = self.slots
        slots = np.array([known.get(p, -1) for p in distinct], np.int64)
        missing = np.flatnonzero(slots < 0)
        if len(missing):
            slots[missing] = self._add([distinct[i] for i in missing])
        self.uses[slots] += 1
        slots = slots[coded.indices.to_numpy()]
        sizes = self.size[slots]
        ends = np.cumsum(sizes)
        at = np.repeat(self.begin[slots] - ends + sizes, sizes)
        at += np.arange(len(at))
        ids = self.pool[at]
        bounds = np.concatenate([[0], ends])[np.searchsorted(start, offsets)]
        if len(odd):
            parts = [ids[bounds[i] : bounds[i + 1]] for i in range(len(texts))]
            for i in odd:  # one at a time: a whole text's encoding is many times its size
                parts[i] = np.array(self._plain(self.tokenizer, [texts[int(i)].as_py()])[0], np.int32)
            bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            ids = np.concatenate(parts)
        return ids, bounds


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, ordinary: bool = False) -> Encoder:
    """This worker's encoder for a tokenizer file."""
    if (path, ordinary) not in _ENCODERS:
        _ENCODERS[path, ordinary] = Encoder(path, ordinary)
        give_back()  # what parsing the file took
    return _ENCODERS[path, ordinary]
