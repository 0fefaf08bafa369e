"""Words of whole UTF-8 texts as numpy arrays, straight from Arrow buffers.

A block of texts is one byte array with document offsets.  Words are runs of
bytes of a class; every byte of a multi-byte character is above 0x7F, so byte
classes and code point classes agree for the classes used here.  Each word gets
a 64-bit hash, and runs of words a hash combined from those.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

FOLD = np.arange(256, dtype=np.uint8)
FOLD[ord("A") : ord("Z") + 1] += 32

#: Bytes of words `[^\x20\x09-\x0D]+`.
UNSPACED = np.ones(256, dtype=bool)
UNSPACED[[0x20, *range(0x09, 0x0E)]] = False

#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`.
LETTERS = np.zeros(256, dtype=bool)
LETTERS[0x30:0x3A] = LETTERS[0x61:0x7B] = LETTERS[0x80:] = True

_KEEP = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [2**64 - 1], dtype=np.uint64)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_STEP = 0x2545F4914F6CDD1D | 1
_LONG = 256
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = h ^ (h >> np.uint64(32))
    h = h * _M2
    h ^= h >> np.uint64(29)
    h *= _M1
    h ^= h >> np.uint64(32)
    return h


@dataclass
class Words:
    """Words of a block.  ``first[d]:first[d + 1]`` are those of document d."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def documents(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1, dtype=np.int64), self.counts)

    def hashes(self) -> np.ndarray:
        return word_hashes(self.data, self.starts, self.ends)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and len + 1 offsets; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def _loose(kind: pa.DataType) -> pa.DataType:
    if pa.types.is_struct(kind):
        return pa.struct([pa.field(f.name, _loose(f.type)) for f in kind])
    if pa.types.is_list(kind):
        return pa.list_(pa.field(kind.value_field.name, _loose(kind.value_type)))
    if pa.types.is_map(kind):
        return pa.map_(_loose(kind.key_type), _loose(kind.item_type))
    return kind


def loose(column: pa.Array) -> pa.Array:
    """The same values, of a type whose fields may be null, as the schemas declared to Spark say."""
    kind = _loose(column.type)
    return column if kind == column.type else column.cast(kind)


def find_words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, fold: bool = False) -> Words:
    if fold:
        data = FOLD[data]
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(len(offsets), np.int64))
    inside = kind[data]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    heads = offsets[:-1][np.diff(offsets) > 0]
    before[heads] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[heads[1:] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end], eight bytes at a time."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(data),), "<u8", padded, strides=(1,))
    size = ends - starts
    h = size.astype(np.uint64) * _M1
    h ^= lanes[starts] & _KEEP[np.minimum(size, 8)]
    h *= _M2
    h ^= h >> np.uint64(32)
    at, rest = 8, np.flatnonzero(size > 8)
    while len(rest) and at < _LONG:
        left = size[rest] - at
        part = (h[rest] ^ (lanes[starts[rest] + at] & _KEEP[np.minimum(left, 8)])) * _M2
        h[rest] = part ^ (part >> np.uint64(32))
        rest = rest[left > 8]
        at += 8
    for i in rest:
        h[i] = np.uint64(xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes()))
    return mix(h)


def run_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the len(h) - n + 1 runs of n values (those across documents too)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    power = lambda k: np.uint64(pow(_STEP, k, 2**64))
    out, have, block, width, left = None, 0, h, 1, n
    while left:
        if left & 1:
            out = block if out is None else out[: len(h) - have - width + 1] * power(width) + block[have : have + len(h) - have - width + 1]
            have += width
        left >>= 1
        if left:
            block = block[: len(block) - width] * power(width) + block[width:]
            width *= 2
    return mix(out[: len(h) - n + 1])


def row_hashes(columns: list[np.ndarray]) -> np.ndarray:
    """What `run_hashes` gives for the runs columns[0][i], columns[1][i] ..."""
    out = columns[0].copy()
    for c in columns[1:]:
        out = out * np.uint64(_STEP) + c
    return mix(out)


def whole_runs(words: Words, n: int) -> np.ndarray:
    """Indexes of the words from which n consecutive words of one document start."""
    ends = np.repeat(words.first[1:], words.counts)
    return np.flatnonzero(np.arange(len(words.starts)) + n <= ends)


def trim() -> None:
    """Give memory that has been freed back to the system, as workers and the driver live on."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def blocks(batches: Iterable[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows, in order, in batches of about `most` bytes of text (one row at least)."""
    try:
        yield from _blocks(batches, column, most)
    finally:
        trim()


def _blocks(batches: Iterable[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    size = 0

    def joined() -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.binary_length(batch.column(batch.schema.get_field_index(column)))
        total = np.cumsum(pc.fill_null(lengths, 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at, base = 0, 0
        while at < batch.num_rows:
            to = max(int(np.searchsorted(total, base + most - size, "right")), at + (not held))
            if to > at:
                held.append(batch.slice(at, to - at))
                size += int(total[to - 1]) - base
                at, base = to, int(total[to - 1])
            if at < batch.num_rows:
                yield joined()
                held, size = [], 0
    if held:
        yield joined()
