"""Numbers of words, and rows of numbers on their way through a shuffle.

A word's number is small where the word is frequent, so rows of numbers compress
well.  Words and numbers are in sorted hash arrays in the shared folder.  Rows
travel as blobs: a task gathers what it has for all shards until each shard's
part is worth a blob, so their number does not grow with that of the blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import lookup, pack, shard_of, steps, sum_by, unpack, write_table
from .shared import tidy
from .words import blocks, mix, row_hashes

#: Rows for each shard that a task gathers before it sends, and rows it holds at most.
SEND_ROWS, HELD_ROWS = 2048, 3_000_000


def table_name(table: str, shard: int) -> str:
    return f"{table}_{shard:06d}"


def distinct_rows(columns: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows, ascending, and the sums of their counts."""
    if not len(counts):
        return columns, counts
    bits = [max(1, int(c.max()).bit_length()) for c in columns]
    if sum(bits) <= 64:
        key = columns[0].copy()
        for c, b in zip(columns[1:], bits[1:], strict=True):
            key = (key << np.uint64(b)) | c
        key, counts = sum_by(key, counts)
        out = []
        for b in reversed(bits):
            out.append(key & np.uint64((1 << b) - 1) if b < 64 else key)
            key = key >> np.uint64(b) if b < 64 else key
        return out[::-1], counts
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    head = np.ones(len(order), bool)
    head[1:] = False
    for c in columns:
        head[1:] |= c[1:] != c[:-1]
    at = np.flatnonzero(head)
    return [c[at] for c in columns], np.add.reduceat(counts[order], at)


def least_bytes(x: np.ndarray) -> np.ndarray:
    """The same numbers in four bytes, if they fit."""
    return x.astype(np.uint32) if not len(x) or int(x.max()) < 1 << 32 else x


def send(kind: str, shards: int, shard: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[str, int, bytes]]:
    """A blob for each shard that has rows; rows ascend, and the first column is sent as steps."""
    order = np.argsort(shard.astype(np.uint16) if shards < 1 << 16 else shard, kind="stable")
    bounds = np.concatenate([[0], np.cumsum(np.bincount(shard, minlength=shards))])
    for s in np.flatnonzero(np.diff(bounds)).tolist():
        part = order[bounds[s] : bounds[s + 1]]
        first, *rest = (least_bytes(c[part]) for c in columns)
        yield kind, s, pack(np.array([x.dtype.itemsize for x in (first, *rest)], np.uint8), steps(first), *rest)


def receive(blobs: list[bytes], n: int) -> list[np.ndarray]:
    """The n columns of the rows of all blobs."""
    parts = []
    for blob in blobs:
        sizes = unpack(blob, np.uint8)[0].tolist()
        _, first, *rest = unpack(blob, np.uint8, *({4: np.uint32, 8: np.uint64}[x] for x in sizes))
        parts.append([np.cumsum(first, dtype=first.dtype), *rest])
    return [np.concatenate([p[i].astype(np.uint64) for p in parts]) for i in range(n)]


_SENT = pa.schema([("kind", pa.string()), ("shard", pa.int64()), ("blob", pa.binary()), ("sums", pa.list_(pa.int64()))])
KIND = "kind string, shard long, blob binary, sums array<long>"


def sent_rows(sent: list[tuple[str, int, bytes]], sums: list[tuple[str, list[int]]] = ()) -> pa.Table:
    rows = [(k, s, b, None) for k, s, b in sent] + [(k, 0, None, n) for k, n in sums]
    return pa.table([pa.array([x[i] for x in rows], t) for i, t in enumerate(_SENT.types)], schema=_SENT)


class Gathered:
    """Rows with counts that a task holds until each shard's part is worth a blob."""

    def __init__(self, shards: int):
        self.most = min(HELD_ROWS, SEND_ROWS * shards)
        self.parts: list[tuple[list[np.ndarray], np.ndarray]] = []
        self.size = 0

    def add(self, columns: list[np.ndarray], counts: np.ndarray) -> bool:
        """Whether it is time to take them."""
        self.parts.append((columns, counts))
        self.size += len(counts)
        return self.size >= self.most

    def take(self) -> tuple[list[np.ndarray], np.ndarray] | None:
        parts, self.parts, self.size = self.parts, [], 0
        if len(parts) < 2:
            return parts[0] if parts else None
        return distinct_rows([np.concatenate(c) for c in zip(*(p[0] for p in parts), strict=True)], np.concatenate([p[1] for p in parts]))


@dataclass
class Vocabulary:
    """Numbers of words (0 opens a document), and which words are frequent."""

    uri: str
    shards: int
    frequent: np.ndarray  # for each number below its length

    def of(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(known, count, number) of word hashes."""
        known, counts, number = lookup(self.uri, "words", shard_of(hashes, self.shards), hashes, 1)
        return known, counts[:, 0], number

    def spread(self, words: list[np.ndarray]) -> np.ndarray:
        """Whether n-grams of these contexts (columns of numbers) are dealt by all their words."""
        out = np.ones(len(words[0]), bool)
        for w in words:
            out &= self.frequent[np.minimum(w, len(self.frequent) - 1)]
        return out

    def route(self, words: list[np.ndarray]) -> np.ndarray:
        """The shard of each n-gram."""
        names = [mix(w) for w in words]
        if len(words) == 1:
            return shard_of(row_hashes(names), self.shards)
        return shard_of(np.where(self.spread(words[:-1]), row_hashes(names), row_hashes(names[:-1])), self.shards)


def words_of(hashes: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct words, and how often each is there."""
    key, n = np.unique(hashes, return_counts=True)
    return [key], n.astype(np.uint64)


def merge_words(uri: str, shards: int, shard: int, blobs: list[bytes], least: int) -> list[tuple[str, list[int]]]:
    """Write the words of a shard, numbered by falling count (numbers of all shards alternate); ("words", size and tokens), ("frequent", numbers of words that occur more than `least` times)."""
    key, n = sum_by(*receive(blobs, 2))
    rank = np.empty(len(n), np.uint64)
    rank[np.lexsort((key, -n.astype(np.int64)))] = np.arange(len(n), dtype=np.uint64)
    number = rank * np.uint64(shards) + np.uint64(shard + 1)
    write_table(uri, table_name("words", shard), key, [n], least_bytes(number))
    return [("words", [len(n), int(n.sum())]), ("frequent", np.sort(number[n > least]).astype(np.int64).tolist())]


def total(kind: str, at: int) -> Column:
    """The sum over all shards of one of the numbers that they report."""
    return F.sum(F.when(F.col("kind") == kind, F.col("sums")[at]))


def often(numbers: list[int] | None) -> np.ndarray:
    """Marks of frequent words, by number; that of the opening mark is among them."""
    out = np.zeros(max([0, *(numbers or [])]) + 2, bool)
    out[[0, *(numbers or [])]] = True
    return out


def number_words(rows: DataFrame, uri: str, shards: int, least: int, hashes: Callable[[pa.Array], np.ndarray], block_bytes: int) -> tuple[Vocabulary, int, int]:
    """The vocabulary of the texts `body`, its size, and the tokens; hashes gives the words of some texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Gathered(shards)

        def flush() -> Iterator[pa.RecordBatch]:
            if (taken := held.take()) is not None:
                (key,), n = taken
                yield from sent_rows(list(send("words", shards, shard_of(key, shards), [key, n]))).to_batches()

        for block in blocks(batches, "body", block_bytes):
            if held.add(*words_of(hashes(block.column(block.schema.get_field_index("body"))))):
                yield from flush()
        yield from flush()

    def merge(table: pa.Table) -> pa.Table:
        return sent_rows([], merge_words(uri, shards, table.column("shard")[0].as_py(), table.column("blob").to_pylist(), least))

    with tidy(rows.sparkSession):
        merged = rows.mapInArrow(count, KIND).groupBy("shard").applyInArrow(merge, KIND)
        size, tokens, frequent = merged.agg(total("words", 0), total("words", 1), F.flatten(F.collect_list(F.when(F.col("kind") == "frequent", F.col("sums"))))).first()
    return Vocabulary(uri, shards, often(frequent)), size or 0, tokens or 0
