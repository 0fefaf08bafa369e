"""Benchmark decontamination with suffix arrays of the training text.

Documents are taken in blocks of a few megabytes.  A block gets a suffix array
over its words; every suffix of every benchmark item is binary-searched in it.
That yields the longest verbatim match of each test suffix and its places, and
from these the words of each document that lie inside a matched window.  A
document never leaves its block, so the documents are read once and not
shuffled.  The benchmark is the stated query set: the executors get it in
blocks of about `block_bytes` of text and hold one at a time, however many
there are.

Defined results: null and empty texts (and items) have no words and match
nothing; repeated rows are scored row by row; items are distinct ids in order;
items of a null id are left out, or with `nameless` matched like others and
listed as one null (the registered query, as its SQL has it, and the pipeline);
other columns of either table are not looked at.
"""

from __future__ import annotations

import itertools
import pickle
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fresh_dir, put, small_batches
from .suffixes import search, suffix_array
from .words import LETTERS, Words, blocks, find_words, loose, text_bytes

#: Bytes of document text in one suffix array, and of benchmark text sent at once.
SHARD_BYTES, BLOCK_BYTES = 4 << 20, 16 << 20
#: Shards that a task holds, with their suffix arrays, while the blocks of a benchmark that has several pass by.
HELD_SHARDS = 4
RESULT = "n_words:long,hits:array<struct<start:long,length:long>>,items:array<string>,longest:struct<item:string,item_word:long,word:long,n_words:long>"


class TestSuffixes:
    """Word hashes of benchmark items, one after the other, with what their windows need."""

    __test__ = False

    def __init__(self, items: list[tuple[str | None, str | None]], window: int, nameless: bool = False):
        items = [x for x in items if nameless or x[0] is not None]
        words = find_words(*text_bytes(pa.array([x[1] for x in items], pa.string())), LETTERS, fold=True)
        self.names = [x[0] for x in items]
        self.hashes = words.hashes()
        self.item = words.documents()
        self.word = np.arange(len(self.hashes)) - words.first[self.item]
        size = words.counts[self.item]
        self.left = size - self.word
        self.need = np.minimum(window, size)
        self.opens = self.left >= self.need
        self.depth = int(size.max(initial=0))


class Suffixes:
    """The words of a shard of documents and its suffix array, made once for the deepest tests so far."""

    def __init__(self, words: Words):
        self.words = words
        self.known, ids = np.unique(words.hashes(), return_inverse=True)
        ends = np.zeros(len(words.starts) + len(words.first) - 1, bool)
        ends[words.first[1:] + np.arange(len(words.first) - 1)] = True
        self.stream = np.zeros(len(ends), np.int64)  # 0 ends a document
        self.stream[~ends] = ids.reshape(-1) + 1
        self.word_at = np.cumsum(~ends) - 1
        self.depth = -1

    def array(self, depth: int) -> np.ndarray:
        if depth > self.depth:
            self.order, self.depth = suffix_array(self.stream, depth), depth
        return self.order


def matches(shard: Suffixes, tests: TestSuffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word of the shard, test suffix) where a whole window matches; the longest match of each suffix."""
    none = np.zeros(0, np.int64)
    known, stream, word_at = shard.known, shard.stream, shard.word_at
    at = np.searchsorted(known, tests.hashes)
    there = at < len(known)
    there[there] = known[at[there]] == tests.hashes[there]
    test = np.where(there, at + 1, -1)
    order = shard.array(tests.depth)
    longest, lo, hi = search(order, stream, test, tests.left, np.where(tests.opens, tests.need, 0))
    hit = np.flatnonzero(hi > lo)
    if not len(hit):
        return none, none, longest
    count = hi[hit] - lo[hit]
    suffix = np.repeat(hit, count)
    base = np.repeat(lo[hit] - (np.cumsum(count) - count), count)
    return word_at[order[base + np.arange(len(suffix))]], suffix, longest


def _report(shard: Suffixes, tests: TestSuffixes) -> list[dict]:
    """What RESULT says for each document of a shard."""
    words = shard.words
    word, suffix, _ = matches(shard, tests)
    out = [{"n_words": int(n), "hits": [], "items": [], "longest": None} for n in words.counts]
    if not len(word):
        return out
    document = np.searchsorted(words.first, word, "right") - 1
    edge = np.zeros(len(words.starts) + 1, np.int64)
    np.add.at(edge, word, 1)
    np.add.at(edge, word + tests.need[suffix], -1)
    covered = np.cumsum(edge[:-1]) > 0
    change = np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8))
    change_doc = words.first[1:-1]
    begin, end = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    cuts = np.unique(np.concatenate([begin, end, change_doc[(change_doc < len(covered))]]))
    cuts = cuts[covered[np.minimum(cuts, len(covered) - 1)] & (cuts < len(covered))]
    stop = np.minimum(end[np.searchsorted(end, cuts, "right")], words.first[np.searchsorted(words.first, cuts, "right")])
    for a, b, d in zip(cuts.tolist(), stop.tolist(), (np.searchsorted(words.first, cuts, "right") - 1).tolist(), strict=True):
        out[d]["hits"].append({"start": a - int(words.first[d]), "length": b - a})
    item = tests.item[suffix]
    for d, i in np.unique(np.stack([document, item], 1), axis=0).tolist():
        out[d]["items"].append(tests.names[i])
    for x in out:
        x["items"] = _distinct(x["items"])
    # A longer match is a run of windows that move on together in the item and in the document.
    sort = np.lexsort((word, word - suffix))
    w, s = word[sort], suffix[sort]
    same = np.ones(len(w), bool)
    same[1:] = (w[1:] != w[:-1] + 1) | (s[1:] != s[:-1] + 1) | (tests.item[s[1:]] != tests.item[s[:-1]]) | (document[sort][1:] != document[sort][:-1])
    head = np.flatnonzero(same)
    size = np.diff(np.append(head, len(w))) - 1 + tests.need[s[head]]
    doc = document[sort][head]
    best = np.lexsort((w[head], -size, doc))
    for j in best[np.unique(doc[best], return_index=True)[1]].tolist():
        d, k = int(doc[j]), int(s[head[j]])
        out[d]["longest"] = {"item": tests.names[int(tests.item[k])], "item_word": int(tests.word[k]), "word": int(w[head[j]] - words.first[d]), "n_words": int(size[j])}
    return out


def _distinct(items: list[str | None]) -> list[str | None]:
    """In order, a null last."""
    return sorted(set(items), key=lambda x: (x is None, x or ""))


def _merge(old: dict, new: dict) -> dict:
    """Of the same document, against two blocks of the benchmark."""
    spans: list[dict] = []
    for x in sorted(old["hits"] + new["hits"], key=lambda x: x["start"]):
        if spans and x["start"] <= spans[-1]["start"] + spans[-1]["length"]:
            spans[-1]["length"] = max(spans[-1]["length"], x["start"] + x["length"] - spans[-1]["start"])
        else:
            spans.append(dict(x))
    longest = max((x["longest"] for x in (old, new) if x["longest"]), key=lambda x: x["n_words"], default=None)
    return {"n_words": old["n_words"], "hits": spans, "items": _distinct(old["items"] + new["items"]), "longest": longest}


def benchmark_blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_bytes: int, nameless: bool = False) -> Iterator[TestSuffixes]:
    """The whole benchmark, in blocks; read row by row, so the driver holds one block."""
    held, size, some = [], 0, False
    rows = benchmark.select(F.col(item_col).cast("string"), F.col(text_col).cast("string"))
    for item, text in rows.toLocalIterator():
        held.append((item, text))
        size += len(text or "")
        if size >= block_bytes:
            yield TestSuffixes(held, window, nameless)
            held, size, some = [], 0, True
    if held or not some:
        yield TestSuffixes(held, window, nameless)


def _sent(session: SparkSession, parts: Iterator[TestSuffixes]) -> tuple[int, Callable[[int], TestSuffixes]]:
    """How many blocks there are, and how a worker gets one.

    A single block, which is bounded, is broadcast; of more, each is a file in
    the shared folder, and a worker holds one at a time.
    """
    first = next(parts)
    second = next(parts, None)
    if second is None:
        only = session.sparkContext.broadcast(first)
        return 1, lambda k: only.value
    uri, count = fresh_dir(session, "benchmark"), 0
    for part in itertools.chain([first, second], parts):
        put(uri, f"{count:06d}", pickle.dumps(part))
        count += 1
    return count, lambda k: _loaded(uri, k)


@lru_cache(maxsize=1)
def _loaded(uri: str, k: int) -> TestSuffixes:
    fs, path = pafs.FileSystem.from_uri(uri)
    with fs.open_input_stream(f"{path}/{k:06d}") as f:
        return pickle.loads(f.read())  # noqa: S301  our own file


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 10, keep: list[str] | None = None, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES, nameless: bool = False) -> DataFrame:
    """A row for each document: its `keep` columns (id_col if not given) and the columns of RESULT.

    hits: spans of words inside a matched window.  items: the ids, as strings,
    of items with such a window.  longest: the longest verbatim match of at
    least a window.  window: words of one (an item of fewer is one window).
    nameless: match items of a null id, too.
    """
    session = docs.sparkSession
    small_batches(session)
    keep = [id_col] if keep is None else keep
    count, load = _sent(session, benchmark_blocks(benchmark, item_col, item_text, window, block_bytes, nameless))
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"), F.col(f"`{text_col}`").cast("string").alias("body"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = blocks(batches, "body", shard_bytes)
        while held := list(itertools.islice(shards, 1 if count == 1 else HELD_SHARDS)):
            suffixes = [Suffixes(find_words(*text_bytes(block.column(1)), LETTERS, fold=True)) for block in held]
            rows = [_report(x, load(0)) for x in suffixes]
            for k in range(1, count):  # a block of the benchmark is loaded once for all shards that are held
                tests = load(k)
                rows = [[_merge(a, b) for a, b in zip(was, _report(x, tests), strict=True)] for was, x in zip(rows, suffixes, strict=True)]
            for block, found_ in zip(held, rows, strict=True):
                yield pa.RecordBatch.from_arrays([loose(block.column(0)), pa.array(found_, type=found)], ["kept", "found"])

    found = pa.struct([("n_words", pa.int64()), ("hits", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))), ("items", pa.list_(pa.string())), ("longest", pa.struct([("item", pa.string()), ("item_word", pa.int64()), ("word", pa.int64()), ("n_words", pa.int64())]))])
    out = kept.mapInArrow(scan, f"kept {kept.schema['kept'].dataType.simpleString()}, found struct<{RESULT}>")
    return out.select("kept.*", "found.*") if not {*keep} & {"n_words", "hits", "items", "longest"} else out


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents, with their own columns, of which no word lies in a matched window."""
    found = find_contamination(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), F.col(f"`{options.pop('text_col', 'text')}`").alias("text")), benchmark, id_col="own", keep=["own"], **options)
    return found.filter(F.size("hits") == 0).select("own.*")


def decontamination_query(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The digest of `find_contamination` for each document."""
    found = find_contamination(docs, benchmark, **options)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda total, x: total + x["length"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


SQL = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), n AS (
  SELECT item, w, least(10, len(w)) AS m FROM b WHERE len(w) > 0
), bw AS (
  SELECT DISTINCT item, m, array_to_string(w[i + 1 : i + m], ' ') AS s FROM (SELECT item, w, m, unnest(range(len(w) - m + 1)) AS i FROM n)
), dp AS (
  SELECT doc_id, w, unnest(range(len(w))) AS i FROM d
), dw AS (
  SELECT doc_id, i, m, array_to_string(w[i + 1 : i + m], ' ') AS s FROM dp CROSS JOIN (SELECT DISTINCT m FROM n) WHERE i + m <= len(w)
), h AS (
  SELECT doc_id, i, m, item FROM dw JOIN bw USING (m, s)
), c AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM h) GROUP BY doc_id
), k AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)
"""
