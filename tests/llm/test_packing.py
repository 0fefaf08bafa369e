from __future__ import annotations

import collections
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from orrery.llm import packing as D


def _plain():
    t = Tokenizer.from_file(public_tokenizers.path(D.TOKENIZER))
    t.encode_special_tokens = True
    return t


PLAIN, OWN = _plain(), D.Ids(D.tokenizer_json(), remembered=200)


def _ids(text):
    return np.asarray(PLAIN.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(alphabet="ab'st 1\n\t é!.,Ö×\x1c漢 ", max_size=25), st.text(max_size=20)), max_size=5))
def test_ids_are_those_of_the_tokeniser(texts):
    assert OWN.encode(texts) == [_ids(t) for t in texts]


def test_odd_texts():
    texts = ["", " ", "  a", "a  b\n c", "x \n y", "<|endoftext|> x", "it's  ok 's", "one.\nTwo, three.", "a" * 5000, "\n\n", "é.\né,", "word.,", "a\r\n b"]
    assert OWN.encode(texts) == [_ids(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.sampled_from([1, 2, 8, 16, 61]).flatmap(lambda w: st.tuples(st.just(w), st.lists(st.integers(1, w), max_size=80))))
def test_plan_equals_packing_one_by_one(case):
    window, lengths = case
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
        rooms.append((min(fits) if fits else window) - n)
    plan, windows = D.best_fit_decreasing(collections.Counter(lengths), window)
    used, spans = collections.Counter(), collections.defaultdict(list)
    for p in plan:
        for k in range(p.count):
            used[p.sequence + k // p.each] += p.length
            at = p.offset + k % p.each * p.length
            spans[p.sequence + k // p.each].append((at, at + p.length))
    assert windows == len(rooms) and sorted(window - u for u in used.values()) == sorted(rooms)
    assert sorted(n for p in plan for n in [p.length] * p.count) == sorted(lengths)
    for s in spans.values():
        s.sort()
        assert s[0][0] == 0 and all(a[1] == b[0] for a, b in zip(s, s[1:], strict=False))


def test_plan_does_not_grow_with_the_input():
    rng = np.random.default_rng(0)
    small, large = (collections.Counter(rng.integers(1, 1025, 20_000).tolist()) for _ in range(2))
    large = {k: v * 1000 for k, v in large.items()}
    assert len(D.best_fit_decreasing(large)[0]) < 3 * len(D.best_fit_decreasing(small)[0])


@given(st.lists(st.integers(0, 40), max_size=20), st.integers(0, 40))
def test_segment_tree(rooms, n):
    tree = D.Capacities(40)
    for r in rooms:
        tree.mark(r, True)
    assert tree.tightest(n) == min((r for r in rooms if r >= n), default=None)


def test_round_trip(corpus):
    got = D.packing_query(corpus).collect()
    rows = [(r.doc_id, _ids(r.text or "") + b"\0\0\0\0") for r in corpus.collect()]
    pieces = collections.Counter()
    for k, ids in rows:
        n = len(ids) // 4
        for a in range(0, n, 1024):
            pieces[k, a, min(1024, n - a), zlib.crc32(ids[4 * a : 4 * a + 4096]), n] += 1
    assert collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == pieces
    spans = collections.defaultdict(list)
    for r in got:
        spans[r.sequence_id].append((r.offset, r.offset + r.length))
    assert sorted(spans) == list(range(len(spans)))
    for s in spans.values():
        s.sort()
        assert s[0][0] == 0 and s[-1][1] <= 1024 and all(a[1] == b[0] for a, b in zip(s, s[1:], strict=False))


def test_empty_table(nothing):
    assert D.packing_query(nothing).count() == 0
