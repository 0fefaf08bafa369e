"""Substring deduplication with prefix-partitioned suffix trees over words.

A suffix of a document is the words from one of its words on.  Suffixes that
start with the same prefix belong to one group; the prefix is one word long
where few suffixes share it and longer where many do, so that a group fits in
the memory of a task.  A group's subtree is built from its sorted suffixes and
the lengths that neighbours have in common: the internal nodes of the tree are
the intervals of these lengths (Abouelhoda et al., 2004).  An internal node of
`min_words` words or more is a word sequence that occurs more than once; one
that different words precede and follow is a maximal repeat.  Below each such
node the smallest document keeps the words, all others lose them.

Suffixes are cut at `depth` words, as a group cannot hold whole texts; a node
at the cut may go on.  For removing words this loses nothing, as the words of a
longer repeat are covered by the nodes of the suffixes that start within it.

How rows move.  Only suffixes whose first `min_words` words occur again can
lie below such a node.  So first all windows of that length are counted, as 40
bits of a hash (a chance equality costs a row, no result), and the words get
numbers (`vocabulary`).  Then a block of documents (a few megabytes) decides
what a smaller document of the same block has, and sends one suffix of each
kind to its group, as sorted rows of word numbers; a passage or copy that fills
a third of the input leaves a block once.  A group sends back the places that
lose words.  The blocks, compressed, meet what came back in one more shuffle.
No task holds more than a group or a block.

The input is read several times in the same order: a table as it is, the result
of a shuffle from a copy that is written first.  A block that comes out
differently all the same is noticed and raises.

Defined results: null and empty texts have no words, and fewer than `min_words`
words make no window: such rows come back as they are.  Equal ids are not
smaller than each other, so rows repeated with their id stay.  Rows with a null
id neither lose words nor make others lose any.  Other columns come back as
they are, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import forget, lookup, pack, shard_of, steps, sum_by, unpack, write_table
from .shared import fresh_dir, small_batches, steady, tidy
from .vocabulary import KIND, Gathered, Vocabulary, least_bytes, merge_words, often, receive, send, sent_rows, table_name, total, words_of
from .words import UNSPACED, Words, blocks, find_words, loose, mix, row_hashes, run_hashes, text_bytes, whole_runs

#: Words of a window; words of a suffix that its group gets; bytes of text in a block; suffixes a group should have at most; groups and shards at least.
MIN_WORDS, DEPTH, BLOCK_BYTES, GROUP_SUFFIXES, LEAST_GROUPS, LEAST_SHARDS = 13, 16, 6 << 20, 500_000, 24, 48
_CLASSES = 1 << 16  # of prefixes of one length, in the census
_FEW = np.uint64((1 << 40) - 1)  # bits of a window's hash that are counted


class Block:
    """Documents of a block in ascending id order (nulls are left out of all comparisons)."""

    def __init__(self, batch: pa.RecordBatch, min_words: int):
        ids = batch.column(0)
        self.known = ~np.asarray(ids.is_null())
        values = ids.fill_null(0).to_numpy(zero_copy_only=False)
        self.order = np.argsort(values, kind="stable")
        self.batch = batch.take(pa.array(self.order))
        self.ids, self.known = values[self.order].astype(np.int64), self.known[self.order]
        data, self.offsets = text_bytes(self.batch.column(1))
        self.words: Words = find_words(data, self.offsets, UNSPACED)
        self.min_words = min_words
        self.name = xxhash.xxh64_hexdigest(self.ids.tobytes() + self.words.starts.tobytes()) + xxhash.xxh64_hexdigest(self.words.data.tobytes())

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first word, document, hash) of each window of the documents with an id; the hashes of all words."""
        h = self.words.hashes()
        at = whole_runs(self.words, self.min_words)
        document = self.words.documents()[at]
        use = self.known[document]
        at, document = at[use], document[use]
        runs = run_hashes(h, self.min_words)
        return at, document, runs[at] if len(at) else np.zeros(0, np.uint64), h


def _first_of(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first of each value of h, in ascending order of the values; for each index the first of its value."""
    order = np.argsort(h, kind="stable")
    head = np.ones(len(h), bool)
    head[1:] = h[order[1:]] != h[order[:-1]]
    first = order[head]
    back = np.empty(len(h), np.int64)
    back[order] = first[np.cumsum(head) - 1]
    return first, back


class Prefixes:
    """Which prefixes are split further, and the group of a suffix."""

    def __init__(self, heavy: dict[int, np.ndarray], least: int, min_words: int, groups: int):
        self.heavy, self.least, self.min_words, self.groups = heavy, least, min_words, groups

    def group(self, h: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of the suffixes that start at the words `at` of all word hashes h."""
        out, todo = np.empty(len(at), np.int64), np.arange(len(at))
        for length in range(self.least, self.min_words + 1):
            prefix = run_hashes(h, length)[at[todo]] if len(todo) else np.zeros(0, np.uint64)
            out[todo] = (prefix & np.uint64(0xFFFFFFFF)).astype(np.int64) % self.groups
            if length not in self.heavy or not len(todo):
                break
            todo = todo[self.heavy[length][(prefix >> np.uint64(48)).astype(np.int64)]]
        return out


@dataclass
class Survey:
    """What a first reading of all documents found: the windows that occur again, the words and their numbers."""

    uri: str
    shards: int
    words: Vocabulary
    suffixes: int  # places of windows that occur again

    def again(self, runs: np.ndarray) -> np.ndarray:
        """Whether a window occurs again (or, by chance, does not)."""
        return lookup(self.uri, "again", shard_of(runs, self.shards), runs & _FEW, 1)[0]


def survey(rows: DataFrame, min_words: int, block_bytes: int) -> Survey:
    uri = fresh_dir(rows.sparkSession, "suffixes")
    size = rows.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    shards = min(max(LEAST_SHARDS, -(-size // (24 << 20))), 1 << 24)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, words = Gathered(shards), Gathered(shards)

        def flush(held: Gathered, kind: str) -> Iterator[pa.RecordBatch]:
            if (taken := held.take()) is None:
                return
            (key,), n = taken
            shard = (key >> np.uint64(40)).astype(np.int64) if kind == "again" else shard_of(key, shards)
            yield from sent_rows(list(send(kind, shards, shard, [key & _FEW if kind == "again" else key, n]))).to_batches()

        for batch in blocks(batches, "body", block_bytes):
            block = Block(batch, min_words)
            _, _, runs, h = block.windows()
            key, n = np.unique((shard_of(runs, shards).astype(np.uint64) << np.uint64(40)) | (runs & _FEW), return_counts=True)
            if windows.add([key], n.astype(np.uint64)):
                yield from flush(windows, "again")
            if words.add(*words_of(h)):
                yield from flush(words, "words")
        yield from flush(windows, "again")
        yield from flush(words, "words")

    def merge(table: pa.Table) -> pa.Table:
        kind, shard = table.column("kind")[0].as_py(), table.column("shard")[0].as_py()
        blobs = table.column("blob").to_pylist()
        if kind == "words":
            return sent_rows([], merge_words(uri, shards, shard, blobs, 1 << 62))
        key, n = sum_by(*receive(blobs, 2))
        more = n > 1
        write_table(uri, table_name("again", shard), key[more], [np.ones(int(more.sum()), np.uint8)])
        return sent_rows([], [("again", [int(n[more].sum())])])

    with tidy(rows.sparkSession):
        merged = rows.mapInArrow(count, KIND).groupBy("kind", "shard").applyInArrow(merge, KIND)
        suffixes = merged.agg(total("again", 0)).first()[0] or 0
    return Survey(uri, shards, Vocabulary(uri, shards, often(None)), suffixes)


def prefixes(rows: DataFrame, found: Survey, min_words: int, group_suffixes: int, block_bytes: int) -> Prefixes:
    """A census of the suffixes that occur again: classes of prefixes of which there are more than half a group get one more word."""
    groups = max(LEAST_GROUPS, -(-found.suffixes // group_suffixes))
    least = 1 + (groups > 1000) + (groups > 1_000_000)
    local = max(1e-5, 1 / (8 * groups))  # a prefix below this share of a block is not worth a row

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: dict[int, np.ndarray] = {}
        try:
            for batch in blocks(batches, "body", block_bytes):
                at, _, runs, h = Block(batch, min_words).windows()
                at = at[found.again(runs)]
                floor = max(2, int(local * len(at)))
                for length in range(least, min_words):
                    if not len(at):
                        break
                    kind = (run_hashes(h, length)[at] >> np.uint64(48)).astype(np.int64)
                    counts = np.bincount(kind, minlength=_CLASSES)
                    many = counts >= floor
                    counted[length] = counted.get(length, 0) + np.where(many, counts, 0)
                    at = at[many[kind]]
        finally:
            forget()
        for length, counts in counted.items():
            kind = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(kind), length)), pa.array(kind), pa.array(counts[kind])], ["length", "class", "n"])

    census = rows.mapInArrow(count, "length long, class long, n long").groupBy("length", "class").agg(F.sum("n").alias("n"))
    heavy: dict[int, np.ndarray] = {}
    limit = max(1, found.suffixes // (2 * groups))
    for length, kind in census.filter(F.col("n") > limit).select("length", "class").collect():  # at most 2 * groups of each length
        heavy.setdefault(length, np.zeros(_CLASSES, bool))[kind] = True
    return Prefixes(heavy, least, min_words, groups)


def _packed(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Rows of numbers as fewer columns of the same order."""
    bits = max([1, *(int(c.max(initial=0)).bit_length() for c in columns)])
    take = max(1, 63 // bits)
    out = []
    for i in range(0, len(columns), take):
        key = columns[i].astype(np.uint64)
        for c in columns[i + 1 : i + take]:
            key = (key << np.uint64(bits)) | c.astype(np.uint64)
        out.append(key)
    return out


def sort_suffixes(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The order of suffixes (columns of word numbers, 0 after the last word), and how many words each has in common with the one before."""
    order = np.lexsort(_packed(columns)[::-1])
    common, still = np.zeros(len(order), np.int64), np.ones(max(0, len(order) - 1), bool)
    for c in columns:
        c = c[order]
        still &= (c[1:] == c[:-1]) & (c[1:] != 0)
        common[1:] += still
    return order, common


def _heads(common: np.ndarray, depth: int) -> np.ndarray:
    """Where the intervals of suffixes begin that have `depth` words in common."""
    head = common < depth
    head[:1] = True
    return np.flatnonzero(head)


def internal_nodes(common: np.ndarray, least: int, depth: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(words, begin, end) of the intervals of sorted suffixes that are internal nodes of `least` words or more; those of `depth` words may go on."""
    for d in range(least, depth + 1):
        begin = _heads(common, d)
        inner = np.append(common, depth + 1)
        inner[begin] = depth + 1
        end = np.append(begin[1:], len(common))
        wide = end - begin > 1
        begin, end = begin[wide], end[wide]
        if not len(begin):
            return
        branch = np.minimum.reduceat(inner, np.stack([begin, end], 1).reshape(-1))[::2]
        yield d, begin[branch == d], end[branch == d]


def _leaves(block: Block, found: Survey, split: Prefixes, depth: int) -> tuple[np.ndarray, list[tuple[int, bytes]]]:
    """Places of a block that lose words to a smaller document of the block; for each group the suffixes it gets.

    Of suffixes with the same words and the same word before, that of the
    smallest document goes, with their number.
    """
    at, document, runs, h = block.windows()
    use = found.again(runs)
    at, document, runs = at[use], document[use], runs[use]
    _, back = _first_of(runs)
    mine = block.ids[document]
    here = at[mine > mine[back]]
    kinds, number = np.unique(h, return_inverse=True)
    number = found.words.of(kinds)[2][number.reshape(-1)]
    end, begin = block.words.first[document + 1], block.words.first[document]
    columns = [np.where(at + j < end, number[np.minimum(at + j, len(number) - 1)], 0) for j in range(depth)] if len(at) else []
    if not len(at):
        return here, []
    before = np.where(at > begin, number[np.maximum(at - 1, 0)], 0)
    pick, same = _first_of(row_hashes([mix(c) for c in (*columns, before)]))
    count = np.bincount(same, minlength=len(at))[pick].astype(np.uint64)
    columns, before, at, document = [least_bytes(c[pick]) for c in columns], least_bytes(before[pick]), at[pick], document[pick]
    group = split.group(h, at)
    sort = np.lexsort([*_packed(columns)[::-1], group])
    bounds = np.searchsorted(group[sort], np.arange(split.groups + 1))
    out = []
    for g in np.flatnonzero(np.diff(bounds)).tolist():
        part = sort[bounds[g] : bounds[g + 1]]
        who, row = np.unique(document[part], return_inverse=True)
        inside = (at[part] - block.words.first[document[part]]).astype(np.uint32)
        ids = block.ids[who]
        out.append((g, pack(np.array([c.dtype.itemsize for c in (*columns, before)], np.uint8), steps(columns[0][part]), *(c[part] for c in (*columns[1:], before)), row.reshape(-1).astype(np.uint32), inside, least_bytes(count[part]).astype(np.uint32), steps(ids), steps(block.words.first[who].astype(np.uint32)))))
    return here, out


@dataclass
class Leaves:
    """Suffixes of a group: word numbers, the word before, how many there are, document id, word in the document, place in the block, blob."""

    columns: list[np.ndarray]
    before: np.ndarray
    count: np.ndarray
    ids: np.ndarray
    word: np.ndarray
    place: np.ndarray
    blob: np.ndarray

    @classmethod
    def of(cls, blobs: list[bytes], depth: int) -> Leaves:
        parts = []
        for i, blob in enumerate(blobs):
            sizes = unpack(blob, np.uint8)[0].tolist()
            _, first, *rest = unpack(blob, np.uint8, *({4: np.uint32, 8: np.uint64}[x] for x in sizes), np.uint32, np.uint32, np.uint32, np.int64, np.uint32)
            row, inside, count, ids, starts = rest[depth:]
            parts.append([np.cumsum(first, dtype=first.dtype), *rest[:depth], count, np.cumsum(ids)[row], inside, np.cumsum(starts, dtype=np.uint32)[row] + inside, np.full(len(row), i)])
        joined = []
        for i in range(len(parts[0])):
            joined.append(np.concatenate([p[i] for p in parts]))
            for p in parts:
                p[i] = None
        return cls(joined[:depth], *joined[depth:])


def _by_blob(blob: np.ndarray, place: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each blob with its places in ascending order; one sort, as a group has a blob of nearly every block."""
    order = np.lexsort((place, blob))
    blob, place = blob[order], place[order]
    head = np.flatnonzero(np.append(True, blob[1:] != blob[:-1])) if len(blob) else np.zeros(0, np.int64)
    for a, b in zip(head.tolist(), [*head[1:].tolist(), len(blob)], strict=bool(len(head))):
        yield int(blob[a]), place[a:b]


def _decided(rows: DataFrame, found: Survey, split: Prefixes, min_words: int, depth: int, block_bytes: int) -> DataFrame:
    """(block, places): words of a block from which a window starts that a smaller document has."""

    def leave(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in blocks(batches, "body", block_bytes):
                block = Block(batch, min_words)
                here, sent = _leaves(block, found, split, depth)
                out = [(-1, block.name, pack(steps(here.astype(np.uint32)))), *((g, block.name, blob) for g, blob in sent)]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.string(), pa.binary()))], ["grp", "block", "places"])
        finally:
            forget()

    def subtree(table: pa.Table) -> pa.Table:
        names, blobs = (table.column(c).to_pylist() for c in ("block", "places"))
        if table.column("grp")[0].as_py() < 0:  # places that a block has decided itself
            return pa.table({"block": names, "places": pa.array(blobs, pa.binary())})
        leaves = Leaves.of(blobs, depth)
        order, common = sort_suffixes(leaves.columns)
        # What lies below a node of min_words words: any deeper node lies below one of these, whose smallest document is no greater.
        begin = _heads(common, min_words)
        ids = leaves.ids[order]
        smallest = np.repeat(np.minimum.reduceat(ids, begin), np.diff(np.append(begin, len(ids))))
        again = np.zeros(len(ids), bool)
        again[order] = ids > smallest
        out = [(names[i], pack(steps(places))) for i, places in _by_blob(leaves.blob[again], leaves.place[again])]
        return pa.table({"block": pa.array([x[0] for x in out], pa.string()), "places": pa.array([x[1] for x in out], pa.binary())})

    sent = rows.select("id", "body").mapInArrow(leave, "grp long, block string, places binary")
    # What blocks decided themselves needs no group; spread by block it only passes through.
    key = F.when(F.col("grp") < 0, -1 - F.pmod(F.xxhash64("block"), F.lit(4096))).otherwise(F.col("grp"))
    return sent.withColumn("grp", key).groupBy("grp").applyInArrow(subtree, "block string, places binary")


def _maximal(leaves: Leaves, min_words: int, depth: int) -> Iterator[tuple]:
    """(words, goes on, occurrences, smallest id, word there) of the maximal repeats of a group."""
    twice = np.repeat(np.arange(len(leaves.count)), np.minimum(leaves.count, 2))  # suffixes that are equal in all their words are neighbours, too
    first = np.ones(len(twice), bool)
    first[1:] = twice[1:] != twice[:-1]
    order, common = sort_suffixes([c[twice] for c in leaves.columns])
    at = twice[order]
    count = np.where(first, leaves.count[twice] - (np.minimum(leaves.count[twice], 2) - 1), 1)[order].astype(np.int64)
    before, ids, word = leaves.before[at].astype(np.int64), leaves.ids[at], leaves.word[at]
    for d, begin, end in internal_nodes(common, min_words, depth):
        for a, b in zip(begin.tolist(), end.tolist(), strict=True):
            own = before[a:b]
            if own.min() == own.max() != 0:
                continue  # one word precedes all of them
            least = a + int(np.lexsort((word[a:b], ids[a:b]))[0])
            yield d, d == depth, int(count[a:b].sum()), int(ids[least]), int(word[least])


def maximal_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, depth: int = 64, block_bytes: int = BLOCK_BYTES, group_suffixes: int = GROUP_SUFFIXES) -> DataFrame:
    """(n_words, goes_on, occurrences, id, word): word sequences of `min_words` words or more that occur more than once and cannot be made longer.

    id and word say where one is: in the document of the smallest id, from
    this word on.  goes_on: the repeat is cut at `depth` words.  Rows with a
    null id are left out.  A group holds `depth` numbers for each suffix.
    """
    small_batches(docs.sparkSession)
    docs = steady(docs)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("body"))
    found = survey(rows, min_words, block_bytes)
    split = prefixes(rows, found, min_words, group_suffixes, block_bytes)

    def leave(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in blocks(batches, "body", block_bytes):
                _, sent = _leaves(Block(batch, min_words), found, split, depth)
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in sent], pa.int64()), pa.array([x[1] for x in sent], pa.binary())], ["grp", "blob"])
        finally:
            forget()

    def nodes(table: pa.Table) -> pa.Table:
        out = list(_maximal(Leaves.of(table.column("blob").to_pylist(), depth), min_words, depth))
        kinds = [("n_words", pa.int64()), ("goes_on", pa.bool_()), ("occurrences", pa.int64()), ("id", pa.int64()), ("word", pa.int64())]
        return pa.table({n: pa.array([x[i] for x in out], t) for i, (n, t) in enumerate(kinds)})

    return rows.mapInArrow(leave, "grp long, blob binary").groupBy("grp").applyInArrow(nodes, "n_words long, goes_on boolean, occurrences long, id long, word long")


def _cut(block: Block, places: list[np.ndarray]) -> np.ndarray:
    """Which words of a block are covered by a decided window."""
    at, document, runs, _ = block.windows()
    chosen = np.zeros(len(block.words.starts) + 1, bool)
    for x in places:
        chosen[x] = True
    # A place stands for the equal windows of its id, too, whichever row has them.
    pick = chosen[at]
    if pick.any():
        wanted = np.unique(runs[pick])
        some = np.flatnonzero(np.isin(runs, wanted))
        code = np.stack([block.ids[document[some]].astype(np.int64).view(np.uint64), runs[some]], 1)
        hit = np.unique(code[pick[some]], axis=0)
        if len(hit) < len(some):
            both = np.concatenate([hit, code])
            _, inverse = np.unique(both, axis=0, return_inverse=True)
            inverse = inverse.reshape(-1)
            wanted_class = np.zeros(inverse.max() + 1, bool)
            wanted_class[inverse[: len(hit)]] = True
            pick[some] = wanted_class[inverse[len(hit) :]]
    edge = np.zeros(len(block.words.starts) + 1, np.int64)
    starts = at[pick]
    edge[: len(block.words.starts)][starts] += 1
    np.subtract.at(edge, starts + block.min_words, 1)
    return np.cumsum(edge[:-1]) > 0


def _digests(words: Words, gone: np.ndarray) -> list[str]:
    """SHA-256 of the words of each document that stay, joined by one space."""
    keep = np.flatnonzero(~gone)
    start, size = words.starts[keep], words.ends[keep] - words.starts[keep] + 1
    to = np.cumsum(size)
    source = np.repeat((start - (to - size)).astype(np.int32), size) + np.arange(to[-1] if len(to) else 0, dtype=np.int32)
    out = np.append(words.data, np.uint8(0))[source]
    out[to - 1] = 0x20
    raw = memoryview(np.ascontiguousarray(out))
    first = np.searchsorted(keep, words.first)
    edge = np.concatenate([[0], to])[first].tolist()
    return [hashlib.sha256(raw[a : max(a, b - 1)]).hexdigest() for a, b in zip(edge[:-1], edge[1:], strict=True)]


def _texts(block: Block, gone: np.ndarray, texts: pa.Array) -> pa.Array:
    """The texts without the words that go, and without the space after each such run."""
    words, out = block.words, None
    for d in np.unique(words.documents()[gone]).tolist():
        a, b = int(words.first[d]), int(words.first[d + 1])
        out = texts.to_pylist() if out is None else out
        stay = np.flatnonzero(~gone[a:b]) + a
        nxt = np.append(words.starts[a + 1 : b], block.offsets[d + 1])
        raw = words.data
        lead = raw[block.offsets[d] : words.starts[a]].tobytes()  # the space before the first word
        pieces = [raw[words.starts[i] : nxt[i - a]].tobytes() for i in stay]
        out[d] = (lead + b"".join(pieces)).decode("utf-8")
    return texts if out is None else pa.array(out, pa.string())


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, block_bytes: int = BLOCK_BYTES, group_suffixes: int = GROUP_SUFFIXES, depth: int | None = None, digest: bool = False, drop_emptied: bool = False) -> DataFrame:
    """Documents without the words that a window of `min_words` covers which also starts in a document of smaller id.

    Windows are judged on the input.  Returns the columns of docs, the text
    replaced; with `digest` instead (id, n_words, n_removed, kept_sha256).
    drop_emptied: leave out documents that had words and lose all of them.
    depth: words of a suffix that its group gets (a few more than min_words).
    """
    small_batches(docs.sparkSession)
    docs = steady(docs)
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("body"), own.alias("own"))
    bodies = rows.select("id", "body")
    known = survey(bodies, min_words, block_bytes)
    split = prefixes(bodies, known, min_words, group_suffixes, block_bytes)
    found = _decided(rows, known, split, min_words, min_words + DEPTH - MIN_WORDS if depth is None else depth, block_bytes)
    keep = [] if digest else ["own"]

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "body", block_bytes):
            block = Block(batch, min_words)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_batch(block.batch)
            yield pa.RecordBatch.from_arrays([pa.array([block.name]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "rows"])

    def finish(table: pa.Table) -> pa.Table:
        kept = [x for x in table.column("rows").to_pylist() if x is not None]
        places = [np.cumsum(unpack(x, np.uint32)[0], dtype=np.uint32) for x in table.column("places").to_pylist() if x is not None]
        if not kept or not places:
            raise RuntimeError("the documents differ between two reads; write them to a table first")
        batch = pa.ipc.open_stream(kept[0]).read_all().combine_chunks().to_batches()
        block = Block(batch[0], min_words)
        gone = _cut(block, places)
        removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[block.words.first])
        if digest:
            out = pa.table({"id": block.batch.column(0), "n_words": block.words.counts, "n_removed": removed, "kept_sha256": _digests(block.words, gone)})
        else:
            text = _texts(block, gone, block.batch.column(1))
            own_ = loose(block.batch.column(block.batch.schema.get_field_index("own")))
            old = own_.field(text_at)
            fields = [text if i == text_at else own_.field(i) for i in range(own_.type.num_fields)]
            if old.null_count and text is not None:
                fields[text_at] = pa.array([None if was is None else now for was, now in zip(old.to_pylist(), text.to_pylist(), strict=True)], pa.string())
            out = pa.table({"own": pa.StructArray.from_arrays([f.cast(own_.type.field(i).type) for i, f in enumerate(fields)], fields=list(own_.type))})
        if drop_emptied:
            out = out.filter(pa.array((removed == 0) | (removed < block.words.counts)))
        return pa.concat_tables([out] * len(kept))

    text_at = docs.columns.index(text_col)
    carried = rows.select("id", "body", *keep).mapInArrow(carry, "block string, rows binary")
    both = carried.withColumn("places", F.lit(None).cast("binary")).unionByName(found.withColumn("rows", F.lit(None).cast("binary")))
    if digest:
        return both.groupBy("block").applyInArrow(finish, "id long, n_words long, n_removed long, kept_sha256 string")
    return both.groupBy("block").applyInArrow(finish, f"own {rows.schema['own'].dataType.simpleString()}").select("own.*")


def repeats_query(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs.select("doc_id", "text"), digest=True).withColumnRenamed("id", "doc_id")


SQL = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), p AS (
  SELECT doc_id, i, array_to_string(w[i + 1 : i + 13], ' ') AS s FROM (SELECT doc_id, w, unnest(range(len(w) - 12)) AS i FROM d WHERE len(w) >= 13)
), m AS (
  SELECT s, min(doc_id) AS least FROM p GROUP BY s
), g AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM p JOIN m USING (s) WHERE doc_id > least
), a AS (
  SELECT doc_id, w, unnest(range(len(w))) AS j FROM d
), k AS (
  SELECT a.doc_id, string_agg(w[j + 1], ' ' ORDER BY j) AS kept FROM a ANTI JOIN g USING (doc_id, j) GROUP BY a.doc_id
), n AS (
  SELECT doc_id, count(*) AS n_removed FROM g GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)
"""
