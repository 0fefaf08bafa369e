from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st

from orrery.llm import decontaminate as D
from orrery.llm.suffixes import search, suffix_array

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _words(text):
    return PATTERN.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, window=10):
    w = _words(text)
    hit, names, places = set(), set(), {}
    for name, item in items:
        x = _words(item)
        n = min(window, len(x))
        if n and n not in places:
            places[n] = {}
            for j in range(len(w) - n + 1):
                places[n].setdefault(tuple(w[j : j + n]), []).append(j)
        for i in range(len(x) - n + 1) if n else ():
            for j in places[n].get(tuple(x[i : i + n]), ()):
                hit.update(range(j, j + n))
                names.add(str(name))
    return len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)


@given(st.lists(st.integers(0, 3), max_size=60), st.integers(1, 40))
def test_suffix_array_is_sorted(values, depth):
    ids = np.array(values, np.int64)
    order = suffix_array(ids, depth)
    keys = [values[i : i + depth] for i in order.tolist()]
    assert sorted(order.tolist()) == list(range(len(values))) and keys == sorted(keys)


@given(st.lists(st.integers(1, 3), max_size=60), st.lists(st.integers(1, 3), min_size=1, max_size=12))
def test_search_finds_longest_matches_and_all_places(values, test):
    ids = np.array(values, np.int64)
    order = suffix_array(ids, len(test))
    left = np.arange(len(test), 0, -1)
    longest, lo, hi = search(order, ids, np.array(test), left, np.minimum(left, 2))
    for i in range(len(test)):
        match = lambda n: [j for j in range(len(values)) if values[j : j + n] == test[i : i + n] and j + n <= len(values)]  # noqa: B023, E731
        assert longest[i] == max((n for n in range(len(test) - i + 1) if n == 0 or match(n)), default=0)
        assert sorted(order[lo[i] : hi[i]].tolist()) == match(min(2, len(test) - i))


@pytest.mark.parametrize("options", [{}, {"shard_bytes": 300}, {"block_bytes": 50}])
def test_equals_brute_force(spark, corpus, options):
    texts = {r.doc_id: r.text for r in corpus.collect() if r.doc_id not in (5, 12, None)}
    items = [(1, " ".join(texts[0].split()[:12])), (2, "w1 w2"), (10, " ".join(texts[4].upper().split())), (3, None), (None, "w3"), (4, "no such words here at all"), (2, "w4 w60"), (5, ", . !")]
    bench = spark.createDataFrame(items, "item_id int, text string")
    got = D.find_contamination(corpus, bench, **options).collect()
    want = {k: brute(t, [x for x in items if x[0] is not None]) for k, t in texts.items()}
    assert len(got) == corpus.count()
    for r in got:
        if r.doc_id in want:
            hit = sum(h.length for h in r.hits)
            assert (r.n_words, hit, len(r["items"])) == want[r.doc_id][:3]
            assert (r.longest is None) == (hit == 0)
            if r.longest:
                w, x = _words(texts[r.doc_id]), [y for n, t in items if str(n) == r.longest["item"] for y in [_words(t)]]
                a, b, n = r.longest.word, r.longest.item_word, r.longest.n_words
                assert any(w[a : a + n] == y[b : b + n] for y in x)
    digest = {r.doc_id: tuple(r)[1:6] for r in D.decontamination_query(corpus, bench).collect()}
    assert all(digest[k] == v for k, v in want.items())
    clean = D.remove_contaminated(corpus, bench)
    assert clean.columns == corpus.columns and clean.schema == corpus.schema
    assert {r.doc_id for r in clean.collect()} & set(want) == {k for k, v in want.items() if not v[1]}


@pytest.mark.parametrize("block_bytes", [D.BLOCK_BYTES, 10])
def test_items_without_an_id_and_repeated_ids(spark, tmp_path, monkeypatch, block_bytes):
    """The registered query against its SQL, whatever the number of blocks; the pipeline's stage drops the same documents."""
    import corpus_pipeline
    import duckdb

    from orrery.llm import registry

    monkeypatch.setattr(D.find_contamination, "__defaults__", tuple(block_bytes if x == D.BLOCK_BYTES else x for x in D.find_contamination.__defaults__))
    docs = spark.createDataFrame([(1, "a b c x y z"), (2, "q r s and p"), (3, "nothing"), (4, "a b c, q r s"), (5, None)], "doc_id long, text string")
    bench = spark.createDataFrame([("x", "a b c"), ("x", "x y z"), (None, "q r s"), (None, "and p"), ("b", "c x")], "item_id string, text string").coalesce(1)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    want = sorted(con.execute(D.SQL).fetchall())
    got = registry.QUERIES["op2_decontaminate"](spark, str(tmp_path))
    assert sorted(tuple(r) for r in got.collect()) == want
    assert [r[5] for r in want] == [True, True, False, True, False]
    assert {r.doc_id for r in corpus_pipeline.remove_contaminated(spark, docs, str(tmp_path)).collect()} == {3, 5}


def test_empty_tables(spark, corpus, nothing):
    bench = spark.createDataFrame([], "item_id int, text string")
    assert D.find_contamination(nothing, bench).count() == 0
    assert D.remove_contaminated(corpus, bench).count() == corpus.count()


def test_an_array_serves_tests_of_any_depth():
    from orrery.llm.words import LETTERS, find_words, text_bytes

    docs = pa.array(["a b c d e f a b c d", "x a b c d e f y", ""])
    tests = [D.TestSuffixes([("short", "a b")], 2), D.TestSuffixes([("long", "a b c d e f y")], 5), D.TestSuffixes([("one", "d")], 10)]
    make = lambda: D.Suffixes(find_words(*text_bytes(docs), LETTERS, fold=True))
    held = make()
    assert [D._report(held, t) for t in tests] == [D._report(make(), t) for t in tests]


def test_blocks_of_a_benchmark_against_held_shards(spark, corpus):
    items = spark.createDataFrame([(f"i{k}", r.text) for k, r in enumerate(corpus.limit(30).collect())], "item_id string, text string")
    key = lambda df: sorted((repr(r) for r in df.collect()))
    docs = corpus.select("doc_id", "text").coalesce(1)
    one = key(D.decontamination_query(docs, items))
    assert key(D.decontamination_query(docs, items, block_bytes=500, shard_bytes=700)) == one
