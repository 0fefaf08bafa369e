"""Context-triggered piecewise hashing, compared by edit distance.

The hash of the last seven bytes decides where a piece of a text ends: at block
size b, where it leaves the remainder b - 1.  Block sizes are 3 * 2**k, so the
ends at 2b are among those at b.  A fingerprint takes the smallest block size
that parts the length into 64 at most, or, where the text has fewer than 32
pieces at that, a smaller one; it has a letter for each piece at that size and
for each piece at twice that: "b:letters:letters".  The 64th piece is all the
rest, so the whole text is hashed, whatever its length.

Two fingerprints are compared where they have letters of the same block size
(equal sizes, or one twice the other): 1 - edit distance / longer length, the
best of those; 0 if no block size is shared, or if both have eight letters at
least and no run of four letters in common (chance agreement).

Defined results: a null or empty text has no pieces, fingerprint "3::"; equal
fingerprints have likeness 1, so repeated rows do.  The next document of the
query follows in ascending order of id (nulls first), then of a hash of the
text; of one document alone, it is itself.  Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches
from .words import blocks, mix, text_bytes, word_hashes

WINDOW, SMALLEST, PIECES = 7, 3, 64
#: Letters that must agree in a row, where both sides have twice as many.
COMMON = 4
#: Bytes of text hashed at once, and in a bucket of neighbouring documents.
BLOCK_BYTES, BUCKET_BYTES = 2 << 20, 16 << 20
LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)


def _ends(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places right after a seven-byte window that ends a piece at the smallest block size, and by how many doublings it still does."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    window = np.ndarray((len(data),), "<u8", padded, strides=(1,)) & np.uint64((1 << 8 * WINDOW) - 1)
    t = (mix(window) >> np.uint64(32)).astype(np.uint32) + np.uint32(1)
    at = np.flatnonzero(t % np.uint32(SMALLEST) == 0)
    inside = at + WINDOW <= offsets[np.searchsorted(offsets, at, "right")]
    at = at[inside]
    low = t[at] & (~t[at] + np.uint32(1))
    return at + WINDOW, np.where(low == 0, 32, np.log2(np.maximum(low, 1))).astype(np.int64)


def _signature(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    return LETTERS[(word_hashes(data, starts, ends) >> np.uint64(58)).astype(np.int64)].tobytes()


def prints(texts: pa.Array) -> list[str]:
    """The fingerprint of each text."""
    data, offsets = text_bytes(texts)
    n = len(offsets) - 1
    place, level = _ends(data, offsets) if len(data) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    first = np.searchsorted(place, offsets, "right")
    doubled, spans = [], []
    for d in range(n):
        a, b = int(offsets[d]), int(offsets[d + 1])
        here, lev = place[first[d] : first[d + 1]], level[first[d] : first[d + 1]]
        inner = here < b
        here, lev = here[inner], lev[inner]  # an end at the end of the text ends nothing more
        above = np.cumsum(np.bincount(lev, minlength=34)[::-1])[::-1]
        k = max(0, (b - a - 1) // (SMALLEST * PIECES)).bit_length()
        while k and above[min(k, 33)] + 1 < PIECES // 2:
            k -= 1
        doubled.append(k)
        for j in (k, k + 1):
            stops = np.append(here[lev >= j][: PIECES - 1], b) if b > a else here[:0]
            spans.append((np.append(a, stops[:-1]) if b > a else stops, stops))
    starts, ends = (np.concatenate([s[i] for s in spans]) if spans else np.zeros(0, np.int64) for i in (0, 1))
    letters = _signature(data, starts, ends)
    to = np.cumsum([0, *(len(s[0]) for s in spans)]).tolist()
    return [f"{SMALLEST << k}:{letters[to[2 * d] : to[2 * d + 1]].decode()}:{letters[to[2 * d + 1] : to[2 * d + 2]].decode()}" for d, k in enumerate(doubled)]


def distances(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """Edit distances of pairs of strings of 64 bytes at most (Myers, 1999; a bit for each letter of left)."""
    a, b = (np.array(x, f"S{PIECES}").view(np.uint8).reshape(-1, PIECES) for x in (left, right))
    m, n = (np.array([len(s) for s in x], np.int64) for x in (left, right))
    up, down = np.full(len(m), 2**64 - 1, np.uint64), np.zeros(len(m), np.uint64)
    score, last, one = m.copy(), np.uint64(1) << np.maximum(m - 1, 0).astype(np.uint64), np.uint64(1)
    for j in range(int(n.max(initial=0))):
        equal = np.packbits(a == b[:, j : j + 1], axis=1, bitorder="little").view(np.uint64).reshape(-1)
        x = equal | down
        h = (((equal & up) + up) ^ up) | equal
        plus, minus = down | ~(h | up), up & h
        go = j < n
        score += go & ((plus & last) != 0)
        score -= go & ((minus & last) != 0)
        plus, minus = (plus << one) | one, minus << one
        up, down = minus | ~(x | plus), plus & x
    return np.where(m == 0, n, score)


def _parts(fingerprint: str) -> tuple[int, bytes, bytes]:
    b, one, two = fingerprint.split(":")
    return int(b), one.encode(), two.encode()


def _share(a: bytes, b: bytes) -> bool:
    if min(len(a), len(b)) < 2 * COMMON:
        return True
    runs = {a[i : i + COMMON] for i in range(len(a) - COMMON + 1)}
    return any(b[i : i + COMMON] in runs for i in range(len(b) - COMMON + 1))


def likeness(left: list[str], right: list[str]) -> np.ndarray:
    """0 to 1 for each pair of fingerprints."""
    out, which, a, b = np.zeros(len(left)), [], [], []
    for i, (x, y) in enumerate(zip(left, right, strict=True)):
        if x == y:
            out[i] = 1.0
            continue
        (bx, x1, x2), (by, y1, y2) = _parts(x), _parts(y)
        pairs = [(x1, y1), (x2, y2)] if bx == by else [(x2, y1)] if by == 2 * bx else [(x1, y2)] if bx == 2 * by else []
        for p, q in pairs:
            if p and q and _share(p, q):
                which.append(i)
                a.append(p)
                b.append(q)
    if which:
        like = 1 - distances(a, b) / np.maximum([len(x) for x in a], [len(x) for x in b])
        np.maximum.at(out, which, like)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) of every row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "body", BLOCK_BYTES):
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(prints(block.column(1)))], ["id", "fingerprint"])

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("body"))
    return rows.mapInArrow(scan, f"id {rows.schema['id'].dataType.simpleString()}, fingerprint string")


def _key(ids: list[int | None], marks: list[int]) -> list[tuple]:
    """The order of documents: nulls first, then ids, then a hash of the text."""
    return [(i is not None, i or 0, m) for i, m in zip(ids, marks, strict=True)]


class Splits:
    """Where buckets begin: 17 bytes for each, which is what Spark holds for a range partitioning, too."""

    def __init__(self, heads: list[tuple]):
        self.known, self.ids, self.marks = (np.array([h[i] for h in heads], t) for i, t in enumerate((bool, np.int64, np.int64)))
        self.nulls = int((~self.known).sum())

    def __len__(self) -> int:
        return len(self.ids)

    def home(self, ids: list[int | None], marks: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The bucket of each document, and whether it is the first of it."""
        known = np.array([i is not None for i in ids], bool)
        value, mark = np.array([i or 0 for i in ids], np.int64), np.array(marks, np.int64)
        some = self.ids[self.nulls :]
        lo = np.where(known, self.nulls + np.searchsorted(some, value), 0)
        hi = np.where(known, self.nulls + np.searchsorted(some, value, "right"), self.nulls)
        place = lo.copy()
        for i in np.flatnonzero(hi > lo).tolist():  # splits within equal ids
            place[i] += np.searchsorted(self.marks[lo[i] : hi[i]], mark[i], "right")
        at = np.maximum(place - 1, 0)
        first = (self.known[at] == known) & (self.ids[at] == value) & (self.marks[at] == mark)
        return at, first


def buckets(rows: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Rows (id, body, mark) with the bucket they belong to, ranges in document order.

    The first document of a bucket also goes, as `guest`, to the bucket before
    (that of the first bucket to the last), so that every document meets its next.
    """
    size = rows.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    keys = rows.select("id", "mark")
    n = max(1, -(-size // bucket_bytes))

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.slice(0, 1)
                for _ in batches:
                    pass

    ranged = keys.repartitionByRange(n, F.asc_nulls_first("id"), "mark").sortWithinPartitions(F.asc_nulls_first("id"), "mark")
    found = ranged.mapInArrow(heads, rows.select("id", "mark").schema).toArrow()  # one row for each bucket
    splits = Splits(sorted(set(_key(found.column("id").to_pylist(), found.column("mark").to_pylist()))))
    sent_splits = rows.sparkSession.sparkContext.broadcast(splits)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sent = sent_splits.value, set()
        for batch in batches:
            if not batch.num_rows:
                continue
            home, first = known.home(batch.column(0).to_pylist(), batch.column(2).to_pylist())
            extra = [i for i in np.flatnonzero(first).tolist() if not (home[i] in sent or sent.add(home[i]))]
            for take, where, guest in ((None, home, False), (extra, (home[extra] - 1) % len(known), True)):
                part = batch if take is None else batch.take(pa.array(take, pa.int64()))
                if part.num_rows:
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(where, pa.int64()), pa.array([guest] * part.num_rows)], [*batch.schema.names, "bucket", "guest"])

    return rows.mapInArrow(deal, "id long, body string, mark long, bucket long, guest boolean")


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document against an edited form of itself and against the next document.

    (id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next); the edited text is described in `neighbour_query`.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("body"))
    dealt = buckets(rows.withColumn("mark", F.xxhash64("body")))
    fields = [("id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]

    def compare(table: pa.Table) -> pa.Table:
        ids, texts, guest = (table.column(c).to_pylist() for c in ("id", "body", "guest"))
        key = _key(ids, table.column("mark").to_pylist())
        own = sorted((i for i, g in enumerate(guest) if not g), key=key.__getitem__)
        following = [*own[1:], guest.index(True)]
        every = [*own, following[-1]]
        edited = []
        for i, j in zip(own, following, strict=True):
            n = len(texts[i]) // 4
            edited.append((texts[i][: len(texts[i]) - n] + texts[j][:n]).encode("utf-8"))
        both = pa.RecordBatch.from_arrays([pa.array([texts[i] for i in every])], ["body"])
        mine = [p for block in blocks([both], "body", BLOCK_BYTES) for p in prints(block.column(0))]
        other = pa.RecordBatch.from_arrays([pa.array(edited, pa.binary())], ["body"])
        new = [p for block in blocks([other], "body", BLOCK_BYTES) for p in prints(block.column(0))]
        columns = [[ids[i] for i in own], [len(texts[i]) for i in own], [hashlib.sha256(e).hexdigest() for e in edited], mine[:-1], new, likeness(mine[:-1], new), likeness(mine[:-1], mine[1:])]
        return pa.table([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], names=[f for f, _ in fields])

    return dealt.groupBy("bucket").applyInArrow(compare, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def neighbour_query(docs: DataFrame) -> DataFrame:
    """The last quarter of a text is replaced by as much of the beginning of the next document."""
    return neighbours(docs).withColumnRenamed("id", "doc_id")
