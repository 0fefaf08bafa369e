"""Best-fit-decreasing packing of tokenised documents into fixed windows.

A document's ids, and one end id, are cut into full windows and a rest.  Best
fit decreasing then takes all rests from the longest to the shortest and puts
each into the open window with the least room that still holds it; a segment
tree over the room that windows have left finds that window.

Only the number of rests of each length matters for where they go, so the
driver packs the histogram (one number for each length up to the window) and
not the rests.  Windows with equal contents move through it as one cohort, and
rests of one length as one run, so the plan has a few thousand rows at any
size of the input, and equals what packing them one by one gives.  Each rest
finds its place by its rank among the rests of its length.

Defined results: a null or empty text is the end id alone; repeated rows are
packed each; null ids stay null; other columns are not looked at.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, small_batches
from .words import blocks

WINDOW, END_ID, TOKENIZER = 1024, 0, "byte_bpe_50k.json"
#: Bytes of text tokenised at once; words whose ids a worker remembers.
BLOCK_BYTES, REMEMBERED = 4 << 20, 1_400_000
_UNSAFE = re.compile(r"\s ")
_LATIN = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+"
_COMPOUND = re.compile(f"({_LATIN})(?=[.,\\n])([.,])?(?:\\n({_LATIN})([.,])?)?")


class Ids:
    """Ids of texts as little-endian 32-bit values.

    No token of a byte-level pre-tokeniser reaches from a visible character
    over the space after it, so a text whose spaces all follow visible
    characters is encoded word by word, and frequent words once.  A word of
    letters is encoded without the full stop, comma or line end after it, which
    are tokens of their own.
    """

    def __init__(self, description: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(description)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are text
        self.remembered, self.known, self.opening = remembered, {}, {}
        self.marks = dict(zip([None, ".", ",", "\n"], [b"", *self._encode([".", ",", "\n"])], strict=True))

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]  # ids without places

    def _learn(self, words: set[str]) -> None:
        """Remember the ids of words that follow a space."""
        known, opening, marks = self.known, self.opening, self.marks
        plain, first, compound = set(), set(), []
        for w in words:
            found = _COMPOUND.fullmatch(w)
            if found is None:
                plain.add(w)
                continue
            compound.append((w, *found.groups()))
            if found[1] not in known:
                plain.add(found[1])
            if found[3] is not None and found[3] not in opening:
                first.add(found[3])
        plain, first = list(plain), list(first)
        known.update(zip(plain, self._encode([f" {w}" for w in plain]), strict=True))
        opening.update(zip(first, self._encode(first), strict=True))
        for w, a, mark, b, end in compound:
            known[w] = known[a] + marks[mark] + (marks["\n"] + opening[b] + marks[end] if b is not None else b"")

    def encode(self, texts: list[str]) -> list[bytes]:
        known = self.known
        if len(known) + len(self.opening) > self.remembered:
            known.clear()
            self.opening.clear()
        split = [None if _UNSAFE.search(t) else t.split(" ") for t in texts]
        heads = self._encode([t if words is None else words[0] for t, words in zip(texts, split, strict=True)])
        found, holes, new = [], [], set()
        for words in split:
            ids = list(map(known.get, words[1:])) if words else []
            hole = [i for i, x in enumerate(ids) if x is None] if None in ids else []
            new.update([words[i + 1] for i in hole])
            found.append(ids)
            holes.append(hole)
        self._learn(new)
        for words, ids, hole in zip(split, found, holes, strict=True):
            for i in hole:
                ids[i] = known[words[i + 1]]
        return [head + b"".join(ids) for head, ids in zip(heads, found, strict=True)]


_WORKER: dict[int, Ids] = {}


def _ids(description: str) -> Ids:
    """A worker keeps one encoder, and the words that it knows, over tasks."""
    key = hash(description)
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = Ids(description)
    return _WORKER[key]


def tokenizer_json(path: str | None = None) -> str:
    """The description at path; that of the installed public tokenizer if none is given."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    with open(path, encoding="utf-8") as f:
        return f.read()


class Capacities:
    """A segment tree over the room windows have left: which is the least room >= n that some window has?"""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.some = [False] * (2 * self.size)

    def mark(self, room: int, some: bool) -> None:
        i = room + self.size
        self.some[i] = some
        while i := i >> 1:
            self.some[i] = self.some[2 * i] or self.some[2 * i + 1]

    def tightest(self, n: int) -> int | None:
        i = n + self.size
        if self.some[i]:
            return n
        while i > 1:
            if not i & 1 and self.some[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.some[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


@dataclass
class Place:
    """Rests of `length` with ranks first .. first + count - 1: `each` to a window, from `sequence` on, at `offset`."""

    length: int
    first: int
    count: int
    sequence: int
    each: int
    offset: int


def best_fit_decreasing(counts: dict[int, int], window: int = WINDOW) -> tuple[list[Place], int]:
    """Where the pieces of each length go, and the number of windows."""
    tree, open_, plan, windows = Capacities(window), {}, [], 0

    def keep(first: int, n: int, room: int) -> None:
        if room and n:
            if room not in open_:
                open_[room] = []
                tree.mark(room, True)
            open_[room].append((first, n))

    for length in sorted((n for n, c in counts.items() if c), reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first, n = window, windows, -(-left // (window // length))
                windows += n
            else:
                first, n = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    tree.mark(room, False)
            each = room // length
            whole = min(n, left // each)
            if whole:
                plan.append(Place(length, rank, whole * each, first, each, window - room))
                keep(first, whole, room - each * length)
                rank, left = rank + whole * each, left - whole * each
            if whole < n and left and left < each:
                plan.append(Place(length, rank, left, first + whole, left, window - room))
                keep(first + whole, 1, room - left * length)
                rank, left, whole = rank + left, 0, whole + 1
            keep(first + whole, n - whole, room)
    return plan, windows


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID, tokenizer: str | None = None) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens) of each full window and rest, with (part, nth): its place among those of its length in its task."""
    spark = docs.sparkSession
    small_batches(spark)
    description = spark.sparkContext.broadcast(tokenizer_json(tokenizer))  # one file, 2 MB
    end = np.array([end_id], "<u4").tobytes()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("body"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = _ids(description.value), TaskContext.get().partitionId()
        nth = np.zeros(window + 1, np.int64)
        for block in blocks(batches, "body", BLOCK_BYTES):
            of, start, length, crc, total = [], [], [], [], []
            for i, ids in enumerate(encoder.encode(block.column(1).to_pylist())):
                ids += end
                n, raw = len(ids) >> 2, memoryview(ids)
                for a in range(0, n, window):
                    of.append(i)
                    start.append(a)
                    length.append(min(window, n - a))
                    crc.append(zlib.crc32(raw[4 * a : 4 * (a + window)]))
                    total.append(n)
            lengths = np.array(length, np.int64)
            order = np.argsort(lengths, kind="stable")
            counts = np.bincount(lengths, minlength=window + 1)
            rank = np.empty(len(lengths), np.int64)
            rank[order] = np.arange(len(lengths)) - np.repeat(np.cumsum(counts) - counts - nth, counts)
            nth += counts
            yield pa.RecordBatch.from_arrays([block.column(0).take(pa.array(of, pa.int64())), pa.array(start, pa.int64()), pa.array(lengths), pa.array(crc, pa.int64()), pa.array(total, pa.int64()), pa.array(np.full(len(of), part)), pa.array(rank)], ["id", "start", "length", "ids_crc32", "doc_tokens", "part", "nth"])

    return rows.mapInArrow(scan, f"id {rows.schema['id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, part long, nth long")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID, tokenizer: str | None = None) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece."""
    cutout = cut(pieces(docs, id_col, text_col, window, end_id, tokenizer))
    spark = docs.sparkSession
    each = cutout.groupBy("part", "length").agg(F.count("*").alias("n"))
    each = cut(each)
    counts = {r.length: r.n for r in each.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row for each length
    plan, _ = best_fit_decreasing(counts, window)
    places = spark.sparkContext.broadcast(plan)  # bounded by the window, not by the input

    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = each.select("part", "length", F.coalesce(before, F.lit(0)).alias("base"))
    ranked = cutout.join(base, ["part", "length"]).select("id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("nth")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = places.value
        order = np.lexsort(([x.first for x in p], [x.length for x in p]))
        table = np.array([[x.length, x.first, x.sequence, x.each, x.offset] for x in p], np.int64).reshape(-1, 5)[order]
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 5))
            at = np.empty(len(length), np.int64)
            for n in np.unique(length):
                mine = np.flatnonzero(length == n)
                a, b = np.searchsorted(table[:, 0], [n, n + 1])
                at[mine] = a + np.searchsorted(table[a:b, 1], rank[mine], "right") - 1
            step = rank - table[at, 1]
            sequence, offset = table[at, 2] + step // table[at, 3], table[at, 4] + step % table[at, 3] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, f"id {cutout.schema['id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def packing_query(docs: DataFrame) -> DataFrame:
    return pack(docs.select("doc_id", "text")).withColumnRenamed("id", "doc_id")
