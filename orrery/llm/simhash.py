"""SimHash near-duplicate detection by tiled exact comparison.

Fingerprints are compared exactly: exclusive-or and bit counts of whole tiles.
Two fingerprints that differ in r bits have bit counts that differ by r at
most, and that holds for the sums over their halves, too.  So a tile holds
fingerprints with the same two bit counts of halves, and a pair of tiles is
skipped if these differ by more than the radius in sum; large tiles are parted
once more by the bit counts of quarters.  Equal fingerprints are one row
before any comparison, so copies cost nothing, and a pair of tiles returns a
spanning forest of its links and not the links, so a large group of near
copies costs at most a row for each of them and pair of tiles.

The comparisons grow with the square of the number of distinct fingerprints;
this is the price of the exact method (README).

Defined results: null and empty texts have fingerprint zero and are linked like
any other; repeated rows get equal results; a null id never becomes the id of a
component (which is null if it has no other); other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import forget, mapped_bytes, pack, put_bytes, unpack
from .components import components, join_hot
from .shared import cut, fresh_dir, remove_dir, small_batches
from .words import UNSPACED, Words, blocks, find_words, run_hashes, text_bytes

SHINGLE, RADIUS, SEED = 3, 3, 42
#: Of near copies by similarity.
SIMILAR_SHINGLE, SIMILARITY, SIMILAR_RADIUS, SIMILAR_TILE = 5, 0.8, 16, 16384
#: Fingerprints in a tile; bytes of text taken at once; pairs compared at once; pairs of near copies compared at once (what a core's cache holds).
TILE, BLOCK_BYTES, AT_ONCE, CACHED = 8192, 2 << 20, 1 << 20, 1 << 17
#: Classes of shingles that are counted; of compared shingles, shards at least and about as many in one.
CLASS_BITS, LEAST_SHARDS, SHARD_SHINGLES = 18, 48, 1_000_000


def spaced(words: Words) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All words with one space after each, and where each begins and ends there."""
    size = words.ends - words.starts + 1
    to = np.cumsum(size)
    source = np.repeat((words.starts - (to - size)).astype(np.int32), size) + np.arange(to[-1] if len(to) else 0, dtype=np.int32)
    out = np.append(words.data, np.uint8(0))[source]
    out[to - 1] = 0x20
    return out.tobytes(), to - size, to - 1


def simhashes(words: Words, shingle: int = SHINGLE) -> np.ndarray:
    """The fingerprint of each document of a block."""
    out = np.zeros(len(words.first) - 1, np.uint64)
    raw, start, end = spaced(words)
    count = words.counts
    n = np.where(count >= shingle, count - shingle + 1, np.minimum(count, 1))
    some = np.flatnonzero(n)
    if not len(some):
        return out
    first = np.cumsum(n[some]) - n[some]
    at = np.repeat(words.first[:-1][some] - first, n[some]) + np.arange(n[some].sum())
    last = np.minimum(at + shingle, np.repeat(words.first[1:][some], n[some])) - 1
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(raw[a:b], SEED) for a, b in zip(start[at].tolist(), end[last].tolist(), strict=True)), np.uint64, len(at))
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    out[some] = np.packbits(ones * 2 > n[some][:, None], axis=1, bitorder="little").view(np.uint64).reshape(-1)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, mark, fingerprint) of every row: SimHash over XXH64 of runs of `shingle` words, A-Z lower-cased; mark is a hash of the text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "body", BLOCK_BYTES):
            words = find_words(*text_bytes(block.column(2)), UNSPACED, fold=True)
            yield pa.RecordBatch.from_arrays([block.column(0), block.column(1), pa.array(simhashes(words, shingle).view(np.int64))], ["id", "mark", "fingerprint"])

    small_batches(docs.sparkSession)
    return _marked(docs, id_col, text_col).mapInArrow(scan, "id long, mark long, fingerprint long")


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, mark, body); rows of equal id and mark have equal texts, null texts apart."""
    text = F.col(f"`{text_col}`").cast("string")
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text).alias("mark"), F.coalesce(text, F.lit("")).alias("body"))


def _union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the sets of a[i] and b[i]; parent stays flat."""
    while True:
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            return parent
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while ((up := parent[parent]) != parent).any():
            parent = up


def _quarters(x: np.ndarray) -> np.ndarray:
    """Bit counts of the first quarter of each half; those of the others follow within a tile."""
    return np.bitwise_count(x >> np.uint64(48)).astype(np.int64) * 32 + np.bitwise_count((x >> np.uint64(16)) & np.uint64(0xFFFF))


def forest(left: np.ndarray, right: np.ndarray, radius: int) -> np.ndarray:
    """A spanning forest of the links between (and, if they are one tile, within) two tiles, as rows (node, parent)."""
    both = np.concatenate([left, right])
    parent = np.arange(len(both))
    parts = [(np.arange(len(left)), np.arange(len(right)))]
    if len(left) * len(right) > 4 * AT_ONCE:
        parts = []
        ql, qr = _quarters(left), _quarters(right)
        by_l, by_r = np.argsort(ql, kind="stable"), np.argsort(qr, kind="stable")
        kl, sl = np.unique(ql[by_l], return_index=True)
        kr, sr = np.unique(qr[by_r], return_index=True)
        halves = [(int(np.bitwise_count(x[0] >> np.uint64(32))), int(np.bitwise_count(x[0] & np.uint64(0xFFFFFFFF)))) for x in (left, right)]
        for i, a in enumerate(kl.tolist()):
            da, db = kr // 32 - a // 32, kr % 32 - a % 32
            far = np.abs(da) + np.abs(db) + np.abs(halves[1][0] - halves[0][0] - da) + np.abs(halves[1][1] - halves[0][1] - db)
            rows = by_l[sl[i] : sl[i + 1] if i + 1 < len(sl) else None]
            near = [by_r[sr[j] : sr[j + 1] if j + 1 < len(sr) else None] for j in np.flatnonzero(far <= radius).tolist()]
            if near:
                parts.append((rows, np.concatenate(near)))
    for rows, columns in parts:
        height = max(1, AT_ONCE // max(1, len(columns)))
        across = right[columns]
        for at in range(0, len(rows), height):
            mine = rows[at : at + height]
            hit = np.flatnonzero(np.bitwise_count(left[mine][:, None] ^ across[None, :]) <= radius)
            if len(hit):
                parent = _union(parent, mine[hit // len(columns)], columns[hit % len(columns)] + len(left))
    child = np.flatnonzero(parent != np.arange(len(both)))
    out = np.stack([both[child], both[parent[child]]], 1)
    return out[out[:, 0] != out[:, 1]]


def _size_class(n: Column, least: float) -> Column:
    """Classes of sizes: sizes of which the lesser is at least `least` of the greater are in the same or in neighbouring ones; 0 is by itself."""
    step = max(-math.log(least), 1e-6) * (1 + 1e-6)  # a little wide, so that rounding parts no two sizes
    return F.when(n > 0, F.floor(F.ln(n) / F.lit(step))).otherwise(F.lit(-2)).cast("long")


def _tile_pairs(nodes: DataFrame, radius: int, tile: int, width: int, least: float | None = None) -> DataFrame:
    """(left, right): arrays of the rows of tiles that may hold fingerprints within the radius, each pair of tiles once.

    A tile's cell is the pair of bit counts of its halves, in steps of width.
    least: and the class of the size n, as rows whose sizes differ by more
    than this share are no candidates.
    """
    ones = lambda x: F.floor(F.bit_count(x) / F.lit(width)).cast("int")
    sized = least is not None and least > 0
    cells = nodes.select(F.struct(*nodes.columns).alias("row"), ones(F.shiftrightunsigned("fingerprint", 32)).alias("a"), ones(F.col("fingerprint").bitwiseAND(F.lit(0xFFFFFFFF))).alias("b"), (_size_class(F.col("n"), least) if sized else F.lit(0)).alias("c"))
    counts = cells.groupBy("a", "b", "c").agg(F.ceil(F.count("*") / F.lit(tile)).alias("parts"))  # 33 * 33 rows at most for each class of sizes
    tiles = (
        cells.join(F.broadcast(counts), ["a", "b", "c"])
        .groupBy("a", "b", "c", F.pmod(F.xxhash64("row.fingerprint"), F.col("parts")).alias("part"))
        .agg(F.collect_list("row").alias("held"))  # about `tile` rows
    )
    tiles = cut(tiles)
    apart = lambda c: 0 if not c else (abs(c) - 1) * width + 1  # noqa: E731  between counts of cells c apart, at least
    reach = radius // width + 2
    steps = [(x, y, z) for x in range(reach + 1) for y in range(-reach, reach + 1) for z in ((-1, 0, 1) if sized else (0,)) if apart(x) + apart(y) <= radius and (x, y, z) >= (0, 0, 0)]
    step = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(z).alias("z")) for x, y, z in steps])).alias("step")
    left = tiles.select("a", "b", "c", F.col("part").alias("part_l"), F.col("held").alias("left"), step).select((F.col("a") + F.col("step.x")).alias("a"), (F.col("b") + F.col("step.y")).alias("b"), (F.col("c") + F.col("step.z")).alias("c"), "part_l", "left", ((F.col("step.x") == 0) & (F.col("step.y") == 0) & (F.col("step.z") == 0)).alias("same"))
    right = tiles.select("a", "b", "c", F.col("part").alias("part_r"), F.col("held").alias("right"))
    pairs = left.join(right, ["a", "b", "c"]).filter("NOT same OR part_l <= part_r").select("left", "right")
    # A pair of full tiles is work for a second; dealing pairs evenly keeps all cores busy.
    return pairs.repartition(_tasks(nodes), F.xxhash64("left", "right"))


def links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links (u, v) that connect what fingerprints within `radius` of each other connect; distinct has each fingerprint once."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                l, r = (np.asarray(batch.column(c)[i].values.field(0)).view(np.uint64) for c in (0, 1))  # noqa: E741
                found = forest(l, r, radius).view(np.int64)
                if len(found):
                    yield pa.RecordBatch.from_arrays([pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy())], ["u", "v"])

    pairs = _tile_pairs(distinct.select("fingerprint"), radius, tile, 1)
    return pairs.mapInArrow(compare, T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())]))


def _tasks(df: DataFrame) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)


def _named(nodes: DataFrame, roots: DataFrame, node: str) -> DataFrame:
    """nodes (node, least, n, ...) with the smallest id of the component of each as `component`, and its `root`."""
    rooted = cut(nodes.join(roots.select(F.col("node").alias("__node"), F.col("root").alias("__root")), F.col(node) == F.col("__node"), "left").withColumn("root", F.coalesce("__root", node)).drop("__node", "__root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component"), F.count("*").alias("__size"))
    return join_hot(rooted, least, "root", "__size", rooted.count())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(id, mark, fingerprint, root, component) of every row; component is the smallest id reachable over links, root a fingerprint that is the same for all of a component."""
    prints = cut(fingerprints(docs, id_col, text_col, shingle))
    nodes = cut(prints.groupBy("fingerprint").agg(F.min("id").alias("least"), F.count("*").alias("n")))
    named = _named(nodes, components(links(nodes.select("fingerprint"), radius)), "fingerprint")
    return join_hot(prints, named.select("fingerprint", "n", "root", "component"), "fingerprint", "n", prints.count())


# Near copies by similarity: fingerprints and rare shingles propose, the sets of shingles decide.


def shingle_sets(words: Words, shingle: int) -> tuple[list[np.ndarray], list[int]]:
    """The distinct shingle hashes of each document, ascending, and a name for each sequence of words."""
    raw, start, end = spaced(words)
    h = words.hashes()
    runs = run_hashes(h, shingle)
    sets, names = [], []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        whole = raw[start[a] : end[b - 1]] if b > a else b""
        names.append(xxhash.xxh64_intdigest(whole, SEED))
        few = b - a < shingle
        sets.append(np.array([names[-1]] if b > a else [], np.uint64) if few else np.unique(runs[a : b - shingle + 1]))
    return sets, names


def _majority(sets: list[np.ndarray]) -> np.ndarray:
    """SimHash of sets of hashes."""
    out = np.zeros(len(sets), np.uint64)
    some = [i for i, s in enumerate(sets) if len(s)]
    if some:
        size = np.array([len(sets[i]) for i in some])
        bits = np.unpackbits(np.concatenate([sets[i] for i in some]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, np.cumsum(size) - size, axis=0, dtype=np.int32)
        out[some] = np.packbits(ones * 2 > size[:, None], axis=1, bitorder="little").view(np.uint64).reshape(-1)
    return out


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of ascending sets; 1 of two empty ones."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return both / (len(a) + len(b) - both)


def verified_forest(left: np.ndarray, right: np.ndarray, radius: int, alike, sizes: tuple[np.ndarray, np.ndarray] | None = None, least: float = 0.0) -> list[tuple[int, int]]:
    """Links that connect all that links of candidates connect; alike(i, j) decides on one of left and one of right.

    sizes: of left and right; where the lesser is below `least` of the greater
    alike says no, so these are not compared.

    Some rows of candidates at a time; in each round every member takes its
    nearest candidate it is not connected with yet, and those that fail are no
    candidates any more.  So each pair is decided at most once, and a large
    group costs about a decision a member.
    """
    n, found = len(left), []
    parent = np.arange(n + len(right))
    by_l, by_r = (np.argsort(x, kind="stable") for x in sizes or (np.zeros(n), np.zeros(len(right))))
    begin, end = np.zeros(n, np.int64), np.full(n, len(right))
    if sizes is not None and least > 0:  # the columns of a row are a run in the order of sizes, and runs do not go back
        own, across = sizes[0][by_l], sizes[1][by_r]
        begin, end = np.searchsorted(across, own * least - 1e-6), np.searchsorted(across, own / least + 1e-6, side="right")
    left, right = left[by_l], right[by_r]
    to = 0
    while (at := to) < n:
        a = int(begin[at])
        to = min(n, at + max(1, CACHED // max(1, int(end[at]) - a)))
        b = int(end[to - 1])
        if a >= b:
            continue
        d = np.bitwise_count(left[at:to, None] ^ right[None, a:b]).reshape(-1)
        hit = np.flatnonzero(d <= radius)
        if not len(hit):
            continue
        hit = hit[np.argsort(d[hit], kind="stable")]
        i, j = by_l[hit // (b - a) + at], by_r[hit % (b - a) + a]
        while len(i):
            apart = parent[i] != parent[j + n]
            i, j = i[apart], j[apart]
            pick = np.unique(np.concatenate([np.unique(i, return_index=True)[1], np.unique(j, return_index=True)[1]]))
            good = np.array([alike(a, b) for a, b in zip(i[pick].tolist(), j[pick].tolist(), strict=True)], bool)
            found += list(zip(i[pick][good].tolist(), j[pick][good].tolist(), strict=True))
            parent = _union(parent, i[pick][good], j[pick][good] + n)
            rest = np.ones(len(i), bool)
            rest[pick] = False
            i, j = i[rest], j[rest]
    return found


def first_shingles(sets: list[np.ndarray], counts: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, place, shingle): the rarest shingles of each set, of which two sets that are `least` similar share one.

    The order is that of the counts of classes, then of the hash; any order that
    all sets have in common would do.  Sets of n shingles that are `least`
    similar share at least least * n, so not all of those can be among the last.
    """
    size = np.array([len(x) for x in sets], np.int64)
    flat = np.concatenate([*sets, np.zeros(0, np.uint32)])
    owner = np.repeat(np.arange(len(sets)), size)
    rank = (counts[flat >> np.uint32(32 - CLASS_BITS)].astype(np.uint64) << np.uint64(32)) | flat
    order = np.lexsort((rank, owner))
    place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    reach = size - np.ceil(least * size - 1e-9).astype(np.int64) + 1
    mine = place < reach[owner]
    return owner[mine], place[mine], flat[order[mine]]


def apart_links(shingle: np.ndarray, place: np.ndarray, row: np.ndarray, size: np.ndarray, group: np.ndarray, least: float, alike) -> list[tuple[int, int]]:
    """Links (rows a, b) that connect what all links across groups connect, among rows that share one of their first shingles.

    Rows whose first common shingle stands too late to be similar, or whose
    sizes differ too much, are no candidates (Xiao et al., 2008); all others
    not yet connected are decided by alike(a, b).
    """
    sort = np.lexsort((row, shingle))
    shingle, place, row = shingle[sort], place[sort], row[sort]
    parent = np.unique(group, return_inverse=True)[1].reshape(-1)
    parent = np.unique(parent, return_index=True)[1][parent]  # a row for each group
    # Runs of a shingle that lie in one group have nothing to decide.
    head = np.flatnonzero(np.concatenate([[True], shingle[1:] != shingle[:-1]])) if len(shingle) else np.zeros(0, np.int64)
    run = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(shingle))))
    mixed = np.minimum.reduceat(parent[row], head) < np.maximum.reduceat(parent[row], head) if len(head) else np.zeros(0, bool)
    some = mixed[run]
    run, place, row = run[some], place[some], row[some]
    found, tested = [], set()
    at, step = np.arange(len(run)), 1

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    up, joined = parent.tolist(), -1
    while len(at):
        if len(found) != joined:  # runs that lie in one group by now have nothing to decide any more
            joined, parent = len(found), np.array(up, np.int64)
            while ((flat := parent[parent]) != parent).any():
                parent = flat
            mine, begin = parent[row], np.flatnonzero(np.append(True, run[1:] != run[:-1]))
            several = np.minimum.reduceat(mine, begin) < np.maximum.reduceat(mine, begin)
            at = at[np.repeat(several, np.diff(np.append(begin, len(run))))[at]]
        at = at[at + step < len(run)]
        at = at[run[at] == run[at + step]]
        a, b, i, j = row[at], row[at + step], place[at], place[at + step]
        shared = np.minimum(size[a] - i, size[b] - j)  # if this one is the first
        near = (parent[a] != parent[b]) & (shared >= least / (1 + least) * (size[a] + size[b]) - 1e-9) & (np.minimum(size[a], size[b]) >= least * np.maximum(size[a], size[b]) - 1e-9)
        for x, y in zip(a[near].tolist(), b[near].tolist(), strict=True):
            one, two = top(x), top(y)
            if one == two or (x, y) in tested:
                continue
            if len(tested) >= AT_ONCE:
                tested.clear()  # what is forgotten is decided again
            tested.add((x, y))
            if alike(x, y):
                found.append((x, y))
                up[max(one, two)] = min(one, two)
        step += 1
    return found


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SIMILAR_SHINGLE, least: float = SIMILARITY, radius: int = SIMILAR_RADIUS, tile: int = SIMILAR_TILE) -> DataFrame:
    """(id, mark, root, component) of every row: documents are linked whose sets of `shingle` words are `least` similar or more.

    component is the smallest id of a group, root a name of it; mark is a hash
    of the text.

    Texts whose SimHashes over these sets differ in `radius` bits at most are
    candidates first, which connects large groups at little cost and most of
    the rest.  Then texts of different components that share one of their
    rarest shingles are, and similar sets always do; so every link counts,
    whatever the radius.  Each is decided by the sets themselves, 32 bits of a
    shingle's hash, which workers map from the shared folder: sets of m and n
    shingles agree in one that is not shared with a chance of m * n / 2**32, for
    two texts of 4,000 words one in 270, which moves their similarity by
    1 / 8,000.  Texts of equal words are one node.
    """
    spark = docs.sparkSession
    small_batches(spark)
    uri = fresh_dir(spark, "shingles")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "body", BLOCK_BYTES):
            words = find_words(*text_bytes(block.column(2)), UNSPACED, fold=True)
            sets, names = shingle_sets(words, shingle)
            small = [np.unique((s >> np.uint64(32)).astype(np.uint32)) for s in sets]
            flat = np.concatenate([*small, np.zeros(0, np.uint32)]).tobytes()
            file = np.uint64(xxhash.xxh64_intdigest(flat)).astype(np.int64)
            put_bytes(uri, str(file), flat)
            size = np.array([len(s) for s in small], np.int32)
            columns = [block.column(0), block.column(1), pa.array(np.array(names, np.uint64).view(np.int64)), pa.array(_majority(sets).view(np.int64)), pa.array(np.full(len(sets), file)), pa.array((np.cumsum(size) - size).astype(np.int32)), pa.array(size)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "mark", "node", "fingerprint", "file", "at", "n"])

    prints = cut(_marked(docs, id_col, text_col).mapInArrow(scan, "id long, mark long, node long, fingerprint long, file long, at int, n int"))
    nodes = cut(prints.groupBy("node").agg(F.min("id").alias("least"), F.count("*").alias("rows"), F.min(F.struct("fingerprint", "file", "at", "n")).alias("s")))

    def set_at(file: int, at: int, n: int) -> np.ndarray:
        return np.frombuffer(mapped_bytes(uri, str(file)), np.uint32, n, 4 * at) if n else np.zeros(0, np.uint32)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                for k in range(batch.num_rows):
                    yield decided(*(batch.column(c)[k].values for c in (0, 1)))
        finally:
            forget()  # a file that is mapped keeps its space after it is removed

    def decided(*sides: pa.StructArray) -> pa.RecordBatch:
        prints_ = [np.asarray(s.field("fingerprint")).view(np.uint64) for s in sides]
        names = [np.asarray(s.field("node")) for s in sides]
        where = [list(zip(*(s.field(c).to_pylist() for c in ("file", "at", "n")), strict=True)) for s in sides]
        found = verified_forest(*prints_, radius, lambda i, j: names[0][i] == names[1][j] or similarity(set_at(*where[0][i]), set_at(*where[1][j])) >= least, [np.asarray(s.field("n")) for s in sides], least)
        found = [(int(names[0][i]), int(names[1][j])) for i, j in found if names[0][i] != names[1][j]]
        return pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], pa.int64()) for c in (0, 1)], ["u", "v"])

    pairs = _tile_pairs(nodes.select("s.fingerprint", "node", "s.file", "s.at", "s.n"), radius, tile, radius, least)
    roots = components(pairs.mapInArrow(compare, "u long, v long"))
    rooted = cut(nodes.join(roots, "node", "left").select("node", "least", "rows", F.coalesce("root", "node").alias("root"), "s.file", "s.at", "s.n"))

    # What the fingerprints left apart: the components that similar sets connect.
    placed = rooted.select("root", "file", "at", "n").repartition(_tasks(docs), "file")
    shards = max(LEAST_SHARDS, -(-int((placed.agg(F.sum("n")).first()[0] or 0) * (1 - least)) // SHARD_SHINGLES))

    def census(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << CLASS_BITS, np.int64)
        for batch in batches:
            for one in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True):
                np.add.at(total, set_at(*one) >> np.uint32(32 - CLASS_BITS), 1)
        forget()
        yield pa.RecordBatch.from_arrays([pa.array([pack(total)], pa.binary())], ["counts"])

    counts = np.zeros(1 << CLASS_BITS, np.int64)
    for row in placed.mapInArrow(census, "counts binary").toLocalIterator():  # a fixed number for each task
        counts += unpack(row.counts, np.int64)[0]
    counts = spark.sparkContext.broadcast(np.minimum(counts, 2**32 - 1).astype(np.uint32))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            root, file = (np.asarray(batch.column(c)) for c in (0, 1))
            at, n = (np.asarray(batch.column(c)) for c in (2, 3))
            sets = [set_at(*x) for x in zip(file.tolist(), at.tolist(), n.tolist(), strict=True)]
            owner, place, first = first_shingles(sets, counts.value, least)
            del sets
            forget()
            shard = first % np.uint32(shards)
            order = np.argsort(shard, kind="stable")
            bounds = np.searchsorted(shard[order], np.arange(shards + 1))
            out = []
            for k in np.flatnonzero(np.diff(bounds)).tolist():
                part = order[bounds[k] : bounds[k + 1]]
                who, row = np.unique(owner[part], return_inverse=True)
                out.append((k, pack(first[part], place[part].astype(np.uint32), row.reshape(-1).astype(np.uint32), root[who], file[who], at[who], n[who])))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], ["shard", "blob"])

    def match(table: pa.Table) -> pa.Table:
        parts = [unpack(x, np.uint32, np.uint32, np.uint32, np.int64, np.int64, np.int32, np.int32) for x in table.column("blob").to_pylist()]
        begin = np.cumsum([0, *(len(x[3]) for x in parts)])
        first, place = (np.concatenate([x[c] for x in parts]) for c in (0, 1))
        row = np.concatenate([x[2].astype(np.int64) + k for x, k in zip(parts, begin.tolist(), strict=False)])
        root, file, at, n = (np.concatenate([x[c] for x in parts]) for c in (3, 4, 5, 6))
        del parts

        def set_of(i: int) -> np.ndarray:
            return set_at(int(file[i]), int(at[i]), int(n[i]))

        try:
            found = apart_links(first, place.astype(np.int64), row, n.astype(np.int64), root, least, lambda i, j: similarity(set_of(i), set_of(j)) >= least)
        finally:
            forget()
        return pa.table([pa.array([int(root[x[c]]) for x in found], pa.int64()) for c in (0, 1)], ["u", "v"])

    more = components(placed.mapInArrow(deal, "shard long, blob binary").groupBy("shard").applyInArrow(match, "u long, v long"))
    remove_dir(uri)  # the links are decided and written
    per = rooted.groupBy("root").agg(F.count("*").alias("__size"))
    per = per.join(more.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
    joined = join_hot(rooted.select("node", "least", "rows", "root"), per.select("root", "__size", F.coalesce("top", "root").alias("top")), "root", "__size", rooted.count())
    joined = cut(joined.select("node", "least", "rows", F.col("top").alias("root")))
    least = joined.groupBy("root").agg(F.min("least").alias("component"), F.count("*").alias("__size"))
    named = join_hot(joined, least, "root", "__size", joined.count())
    return join_hot(prints.select("id", "mark", "node"), named.select("node", "rows", "root", "component"), "node", "rows", prints.count()).select("id", "mark", "root", "component")


def keep_first(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, that of the smallest id and, of rows that share it, of the smallest hash of the text; rows without an id stay.

    found: (id, mark, root) of every row.  Rows of equal id and text are one
    document; of these, if other columns differ, that of the smallest hash of
    all columns stays.
    """
    best = found.filter("id IS NOT NULL").groupBy("root").agg(F.min(F.struct("id", "mark")).alias("__best")).select("__best.*")
    rows = found.filter("id IS NOT NULL").groupBy("id", "mark").agg(F.count("*").alias("__rows"))
    kept = best.join(rows, ["id", "mark"]).select(F.col("id").alias("__id"), F.col("mark").alias("__mark"), "__rows")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), F.col(f"`{id_col}`").cast("long").alias("__a"), F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("__b"))
    stay = own.filter("__a IS NOT NULL").join(kept, (F.col("__a") == F.col("__id")) & (F.col("__b") == F.col("__mark")))
    same = stay.filter("__rows > 1").groupBy("__a", "__b").agg(F.min_by("own", F.xxhash64(*[F.col(f"own.`{f.name}`") for f in docs.schema if "map" not in f.dataType.simpleString()])).alias("own"))
    return stay.filter("__rows = 1").select("own.*").unionByName(same.select("own.*")).unionByName(docs.filter(F.col(f"`{id_col}`").isNull()))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Of each group that fingerprints link one document stays."""
    return keep_first(docs, near_duplicates(docs, id_col, text_col, **options), id_col, text_col)


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Of each group of similar documents one stays."""
    return keep_first(docs, similar_documents(docs, id_col, text_col, **options), id_col, text_col)


def simhash_query(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
