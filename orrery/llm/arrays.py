"""Compressed columns for shuffles, and sorted hash arrays that workers map into memory.

A sorted hash array holds keys of 64 bits and a few counts for each.  Files are
ranges of the first half of a key, so within a file keys are ordered by the
second half first.  A directory over its first bits (a cell for about eight
keys) stands in for these bits, and the 32 bits after them are kept: a key that
is not there is found all the same with a chance of about 8 / 2**32.  Rows of counts are numbered: one byte names one
of the 255 commonest rows of the file, or says that the row is in a list of
exceptions.
"""

from __future__ import annotations

import mmap
import os
import sys
from functools import lru_cache

import numpy as np
import pyarrow.fs as pafs
import zstandard

from .shared import put
from .words import mix


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays in one blob; bytes of equal weight lie together, which suits sorted or small values."""
    out = []
    for x in arrays:
        out.append(np.array([len(x), x.dtype.itemsize], np.int64).tobytes())
        out.append(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack(blob: bytes, *kinds: type) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(blob, max_output_size=1 << 31), 0, []
    for kind in kinds:
        n, width = np.frombuffer(raw, np.int64, 2, at).tolist()
        at += 16
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T).view(kind).reshape(-1))
        at += n * width
    return out


def steps(x: np.ndarray) -> np.ndarray:
    """Differences of neighbours; np.cumsum in the same type undoes it."""
    out = x.copy()
    out[1:] -= x[:-1]
    return out


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of the hash, so that shard after shard is one sorted array."""
    return (((h >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


def sum_by(key: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Distinct keys in ascending order, and the sums of the values of each."""
    order = np.argsort(key)
    key = key[order]
    head = np.ones(len(key), bool)
    head[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(head)
    if not len(at):
        return [key, *values]
    return [key[at], *(np.add.reduceat(v[order], at, dtype=v.dtype) for v in values)]


#: Keys in a cell of the directory, about; bits of a key kept beside it; rows of counts that have a number of one byte.
CELL, KEPT, NUMBERED = 8, 32, 255


def _turned(key: np.ndarray) -> np.ndarray:
    return (key << np.uint64(32)) | (key >> np.uint64(32))


def _rows_numbered(counts: list[np.ndarray]) -> list[np.ndarray]:
    """(numbers of one byte, the rows they name, where the exceptions are, their rows)."""
    rows = np.stack([c.astype(np.uint64) for c in counts], 1)
    name = rows[:, 0].copy()
    for i in range(1, rows.shape[1]):
        name = mix(name) + rows[:, i]
    _, at, back, n = np.unique(name, return_index=True, return_inverse=True, return_counts=True)
    common = np.argsort(-n, kind="stable")[:NUMBERED]
    number = np.full(len(at), NUMBERED, np.uint8)
    number[common] = np.arange(len(common))
    out = number[back.reshape(-1)]
    odd = np.flatnonzero(out == NUMBERED)
    return [out, rows[at[common]].reshape(-1), odd.astype(np.uint32), rows[odd].reshape(-1)]


def write_table(uri: str, name: str, key: np.ndarray, counts: list[np.ndarray], wide: np.ndarray | None = None) -> None:
    """A sorted hash array of distinct keys; wide: one more column, kept as it is."""
    key = _turned(key)
    order = np.argsort(key)
    key = key[order]
    bits = min(64 - KEPT, (len(key) // CELL).bit_length())
    cell = key >> np.uint64(64 - bits) if bits else np.zeros(len(key), np.uint64)
    directory = np.searchsorted(cell, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.uint32)
    kept = ((key << np.uint64(bits)) >> np.uint64(64 - KEPT)).astype(np.uint32)
    wide = np.zeros(0, np.uint64) if wide is None else wide[order]
    parts = [directory, kept, *_rows_numbered([c[order] for c in counts]), wide]
    head = np.array([bits, len(counts), *(x for p in parts for x in (len(p), p.dtype.itemsize))], np.int64)
    put(uri, name, b"".join(p.tobytes() + b"\0" * (-p.nbytes % 8) for p in (head, *parts)))


#: Files held at once: in memory, and mapped.  A block of texts asks all files of a table one after the other, so a bound below their number would map each anew for each block.
#: A file that is mapped takes only addresses, and from Python 3.13 on no descriptor.
FETCHED = 256
MAPPED, UNTRACKED = (16384, {"trackfd": False}) if sys.version_info >= (3, 13) else (FETCHED, {})


@lru_cache(maxsize=64)
def _local(uri: str) -> str | None:
    """The path of a folder that is one of a file system here."""
    fs, path = pafs.FileSystem.from_uri(uri)
    return path if isinstance(fs, pafs.LocalFileSystem) else None


@lru_cache(maxsize=MAPPED)
def _opened(path: str) -> mmap.mmap | None:
    if not os.path.exists(path):
        return None
    with open(path, "rb") as f:
        return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, **UNTRACKED)


@lru_cache(maxsize=FETCHED)
def _fetched(uri: str, name: str) -> bytes | None:
    fs, path = pafs.FileSystem.from_uri(uri)
    path = f"{path}/{name}"
    if fs.get_file_info(path).type == pafs.FileType.NotFound:
        return None
    with fs.open_input_stream(path, compression=None) as f:
        return f.read()


def _mapped(uri: str, name: str) -> mmap.mmap | bytes | None:
    """A shared file, mapped; in memory where the shared folder is no file system here; none if there is no such file."""
    folder = _local(uri)
    return _fetched(uri, name) if folder is None else _opened(f"{folder}/{name}")


def forget() -> None:
    """Unmap all files: one that is mapped keeps its space after it is removed."""
    for held in (_opened, _fetched, _mapped_table, _fetched_table):
        held.cache_clear()


def _table(uri: str, name: str) -> tuple | None:
    return _fetched_table(uri, name) if _local(uri) is None else _mapped_table(uri, name)


def _read_table(uri: str, name: str) -> tuple | None:
    view = _mapped(uri, name)
    if view is None:
        return None
    bits, width = np.frombuffer(view, np.int64, 2).tolist()
    shapes = np.frombuffer(view, np.int64, 14, 16).reshape(7, 2).tolist()
    at, out = 8 * 16, []
    for n, size in shapes:
        out.append(np.frombuffer(view, {1: np.uint8, 4: np.uint32, 8: np.uint64}[size], n, at))
        at += -(-n * size // 8) * 8
    return bits, width, *out


_mapped_table, _fetched_table = (lru_cache(maxsize=n)(_read_table) for n in (MAPPED, FETCHED))


def lookup(uri: str, table: str, shard: np.ndarray, key: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(found, counts, wide) of keys in the tables `table`_0, `table`_1 ... of their shards; counts has a row for each key, 0 where it is not there."""
    found, counts, wide = np.zeros(len(key), bool), np.zeros((len(key), width), np.uint64), np.zeros(len(key), np.uint64)
    if not len(key):
        return found, counts, wide
    key = _turned(key)
    order = np.argsort(key)
    order = order[np.argsort(shard[order].astype(np.uint16) if shard.max() < 1 << 16 else shard[order], kind="stable")]
    shards, first = np.unique(shard[order], return_index=True)
    for s, a, b in zip(shards.tolist(), first.tolist(), [*first[1:].tolist(), len(order)], strict=True):
        held = _table(uri, f"{table}_{s:06d}")
        if held is None or not len(held[3]):
            continue
        bits, _, directory, kept, number, rows, odd, odd_rows, more = held
        where = order[a:b]
        asked = key[where]
        cell = (asked >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(asked), np.int64)
        want = ((asked << np.uint64(bits)) >> np.uint64(64 - KEPT)).astype(np.uint32)
        lo, hi = directory[cell].astype(np.int64), directory[cell + 1].astype(np.int64)
        end = hi.copy()
        while (open_ := lo < hi).any():
            mid = (lo + hi) >> 1
            less = open_ & (kept[np.minimum(mid, len(kept) - 1)] < want)
            lo = np.where(less, mid + 1, lo)
            hi = np.where(open_ & ~less, mid, hi)
        hit = np.flatnonzero((lo < end) & (kept[np.minimum(lo, len(kept) - 1)] == want))
        lo, where = lo[hit], where[hit]
        found[where] = True
        n = number[lo].astype(np.int64)
        plain = n < NUMBERED
        counts[where[plain]] = rows.reshape(-1, width)[n[plain]]
        if not plain.all():
            counts[where[~plain]] = odd_rows.reshape(-1, width)[np.searchsorted(odd, lo[~plain])]
        if len(more):
            wide[where] = more[lo]
    return found, counts, wide


def put_bytes(uri: str, name: str, data: bytes) -> None:
    """A file to be mapped; one of no bytes is not written."""
    if data:
        put(uri, name, data)


def mapped_bytes(uri: str, name: str) -> mmap.mmap | bytes:
    return _mapped(uri, name)
