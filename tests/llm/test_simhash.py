from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from orrery.llm import simhash as D
from orrery.llm.components import components


def fingerprint(text, n=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(pairs, nodes):
    up = {x: x for x in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {x: top(x) for x in nodes}


def test_equals_brute_force(corpus):
    rows = [(r.doc_id, fingerprint(r.text)) for r in corpus.collect()]
    prints = {f for _, f in rows}
    part = groups([(a, b) for a in prints for b in prints if (a ^ b).bit_count() <= 3], prints)
    least = {}
    for k, f in rows:
        if k is not None:
            least[part[f]] = min(least.get(part[f], k), k)
    want = sorted(((k, f"{f:016x}", least.get(part[f])) for k, f in rows), key=repr)
    assert sorted((tuple(r) for r in D.simhash_query(corpus).collect()), key=repr) == want
    kept = D.drop_near_duplicates(corpus)
    assert kept.schema == corpus.schema
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([*least.values(), None], key=repr)  # id 12 is the least of two components


@pytest.mark.parametrize("seed", range(6))
def test_tiles_equal_all_pairs(spark, seed, monkeypatch):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(30)]
    some = {*base, 0, 2**64 - 1}
    for b in base:
        for _ in range(6):
            b ^= sum(1 << rng.randrange(64) for _ in range(2))
            some.add(b & (2**64 - 1))
    signed = [x - 2**64 if x >= 2**63 else x for x in some]
    edges = D.links(spark.createDataFrame([(x,) for x in signed], "fingerprint long"), tile=8 if seed % 2 else 1000)
    got = {r.node: r.root for r in components(edges).collect()}
    want = groups([(a, b) for a in signed for b in signed if ((a ^ b) & (2**64 - 1)).bit_count() <= 3], signed)
    assert all(got.get(x, x) == want[x] for x in signed)


def test_parts_of_large_tiles(monkeypatch):
    monkeypatch.setattr(D, "AT_ONCE", 1 << 6)
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 30, dtype=np.uint64)
    some = np.unique(np.concatenate([base, *[base ^ (np.uint64(1) << rng.integers(0, 64, 30).astype(np.uint64)) for _ in range(8)]]))
    key = np.bitwise_count(some >> np.uint64(32)).astype(int) * 64 + np.bitwise_count(some & np.uint64(2**32 - 1))
    for a in np.unique(key)[:25]:
        for b in np.unique(key)[:25]:
            left, right = some[key == a].tolist(), some[key == b].tolist()
            found = D.forest(np.array(left, np.uint64), np.array(right, np.uint64), 3).tolist()
            nodes = [*left, *right]
            assert groups(found, nodes) == groups([(x, y) for x in left for y in right if (x ^ y).bit_count() <= 3], nodes)


def test_components_of_long_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(60)]
    star = [(1000, 1000 + i) for i in range(1, 40)]
    edges = path + star + [(5, 5), (7, 6)]
    random.Random(0).shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 1000 for i in range(1000, 1040)}}


def test_empty_table(nothing):
    assert D.simhash_query(nothing).count() == D.drop_near_duplicates(nothing).count() == D.drop_similar(nothing).count() == 0


def test_similar_documents_equal_brute_force(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(25):
        w = [f"w{rng.randrange(400)}" for _ in range(rng.randint(3, 120))]
        texts.append(w)
        for _ in range(rng.randint(0, 5)):
            v = list(w)
            for _ in range(rng.randint(0, 4)):
                v[rng.randrange(len(v))] = f"x{rng.randrange(1000)}"
            texts.append(v)
    texts += [[], [], ["one"], ["one"], ["two"]]
    rng.shuffle(texts)
    rows = [(i, "  ".join(t).upper() if i % 2 else "\n".join(t)) for i, t in enumerate(texts)] + [(len(texts), None)]
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} if len(t) >= 5 else {tuple(t)} for t in [*texts, []]]
    like = lambda a, b: len(a & b) / len(a | b)
    want = groups([(i, j) for i in range(len(sets)) for j in range(i) if like(sets[i], sets[j]) >= 0.8], list(range(len(sets))))
    for tile in (4096, 10):
        got = {r.id: r.component for r in D.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"), radius=22, tile=tile).collect()}
        assert got == want
    assert D.drop_similar(spark.createDataFrame(rows, "doc_id long, text string")).count() == len(set(want.values()))


def test_no_link_is_lost_to_the_radius(spark):
    """Nine words against the first eight: 4 of 5 shingles; with the defaults one pair in twelve differs in more than 16 bits."""
    rng = random.Random(8)
    rows, want = [], {}
    for k in range(300):
        w = [f"w{rng.randrange(100000)}" for _ in range(9)]
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(w[:8]))]
        want |= {2 * k: 2 * k, 2 * k + 1: 2 * k}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for options in ({}, {"radius": 1, "tile": 50}):
        assert {r.id: r.component for r in D.similar_documents(docs, **options).collect()} == want


def test_rare_shingles_connect_what_all_pairs_connect():
    rng = random.Random(4)
    sets = []
    for _ in range(40):
        base = rng.sample(range(1 << 32), rng.randint(1, 60)) + list(range(rng.choice([0, 0, 30])))
        for _ in range(rng.randint(1, 5)):
            sets.append(sorted({x for x in base if rng.random() > 0.08} | set(rng.sample(range(1 << 32), rng.randint(0, 3)))))
    sets = [np.array(x, np.uint32) for x in sets if x]
    counts = np.bincount(np.concatenate(sets) >> np.uint32(32 - D.CLASS_BITS), minlength=1 << D.CLASS_BITS)
    row, place, first = D.first_shingles(sets, counts, 0.8)
    size = np.array([len(x) for x in sets])
    found = D.apart_links(first, place, row, size, np.arange(len(sets)), 0.8, lambda i, j: D.similarity(sets[i], sets[j]) >= 0.8)
    nodes = list(range(len(sets)))
    all_pairs = [(i, j) for i in nodes for j in range(i) if D.similarity(sets[i], sets[j]) >= 0.8]
    assert all_pairs and groups(found, nodes) == groups(all_pairs, nodes)


def test_sizes_that_cannot_be_similar_are_not_compared(spark, monkeypatch):
    """One fingerprint and many sizes: every pair within 4 : 5 meets once, and few others are compared."""
    sizes = [0, 0, *range(1, 400), *[5 * 2**k for k in range(7, 12)], *[4 * 2**k for k in range(7, 12)]]
    rows = spark.createDataFrame([(7, i, n) for i, n in enumerate(sizes)], "fingerprint long, node long, n int")
    tiles = D._tile_pairs(rows, 16, 4096, 16, 0.8).collect()
    met, compared, count = set(), [], np.bitwise_count
    monkeypatch.setattr(D.np, "bitwise_count", lambda x: (compared.append(x.size), count(x))[1])
    monkeypatch.setattr(D, "CACHED", 256)
    for t in tiles:
        side = [[np.array([r[c] for r in x], np.uint64 if c == "fingerprint" else np.int64) for c in ("fingerprint", "n")] for x in t]
        alike = lambda i, j: met.add((t.left[i].node, t.right[j].node)) or False  # noqa: B023, E731
        D.verified_forest(side[0][0], side[1][0], 16, alike, (side[0][1], side[1][1]), 0.8)
    want = {(i, j) for i, m in enumerate(sizes) for j, n in enumerate(sizes) if i < j and min(m, n) >= 0.8 * max(m, n)}
    assert want <= {tuple(sorted(x)) for x in met}
    assert all(min(sizes[i], sizes[j]) >= 0.5 * max(sizes[i], sizes[j]) for i, j in met)  # rows that are compared at once share the columns of all of them
    assert sum(compared) < len(sizes) ** 2 / 3


def test_similarity_of_sets():
    a = np.array([1, 3, 5, 7], np.uint64)
    none = np.zeros(0, np.uint64)
    assert D.similarity(a, a) == 1 and D.similarity(a, np.array([3, 4], np.uint64)) == 1 / 5 and D.similarity(none, none) == 1 and D.similarity(a, none) == 0


def test_repeated_ids_lose_no_text(spark):
    rng = random.Random(2)
    a, b, c = ([f"{x}{rng.randrange(10**6)}" for _ in range(40)] for x in "abc")
    rows = [(2, " ".join(a)), (5, " ".join([*a, "x"])), (5, " ".join(b)), (7, " ".join(c)), (7, " ".join(b + c)), (7, " ".join(c)), (None, " ".join(a)), (9, None), (9, "")]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, n int")
    want = [rows[0], rows[2], rows[3], rows[4], rows[6]]
    for parts in (1, 3):
        got = D.drop_similar(docs.repartition(parts)).collect()
        assert sorted(((r.doc_id, r.text) for r in got if r.doc_id != 9), key=repr) == sorted(want, key=repr)
        assert [r.text or "" for r in got if r.doc_id == 9] == [""] and sum(r.n in (3, 5) for r in got) == 1


def test_hub_is_joined_apart(spark, monkeypatch):
    """The same components however many keys are hot."""
    rng = random.Random(1)
    edges = [(0, i) for i in range(1, 400)] + [(500 + rng.randrange(60), 500 + rng.randrange(60)) for _ in range(45)] + [(399, 1000)]
    want = groups(edges, {x for e in edges for x in e})
    for share in (1 / 1000, 1 / 10, 1e-9, 1.0):
        monkeypatch.setattr("orrery.llm.components.HOT", share)
        got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
        assert got == {k: v for k, v in want.items() if k in got} and all(want[x] == x for x in want if x not in got)
