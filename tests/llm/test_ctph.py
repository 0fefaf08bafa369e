from __future__ import annotations

import hashlib
import random

import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st

from orrery.llm import ctph as D


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@given(st.lists(st.tuples(st.binary(max_size=64).map(lambda b: bytes(65 + x % 4 for x in b)), st.binary(max_size=64).map(lambda b: bytes(65 + x % 4 for x in b))), min_size=1, max_size=10))
def test_distances(pairs):
    left, right = map(list, zip(*pairs, strict=True))
    assert D.distances(left, right).tolist() == [levenshtein(a, b) for a, b in pairs]


def _text(rng, n):
    return " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(n))


def test_fingerprints_do_not_depend_on_the_block():
    rng = random.Random(0)
    texts = [_text(rng, rng.randint(0, 400)) for _ in range(40)] + ["", None, "a", "é" * 3000, "abc" * 2000]
    whole = D.prints(pa.array(texts))
    assert whole == [D.prints(pa.array([t], pa.string()))[0] for t in texts]
    assert whole[-5:-3] == ["3::", "3::"] and all(len(p) <= 64 for x in whole for p in x.split(":")[1:])


def test_edits_are_near_and_others_are_not():
    rng = random.Random(1)
    near, far = [], []
    for _ in range(60):
        t = _text(rng, rng.randint(60, 900))
        at = rng.randrange(len(t))
        near.append(D.likeness(*[D.prints(pa.array([x])) for x in (t, t[:at] + "INSERTED" + t[at + 5 :])])[0])
        far.append(D.likeness(*[D.prints(pa.array([x])) for x in (t, _text(rng, rng.randint(60, 900)))])[0])
    assert min(near) > 0.6 and sum(near) / 60 > 0.9 and max(far) < 0.2


def test_block_sizes_must_be_compatible():
    a = "ABCDEFGHIJKLMNOP"
    assert D.likeness([f"3:{a}:{a[:8]}"] * 4, [f"3:{a}:x", f"6:zz:{a}", f"12:{a}:{a}", f"6:{a[:8]}:zz"]).tolist() == [1.0, 0.0, 0.0, 1.0]


@pytest.mark.parametrize("bucket_bytes", [200, 3000, 1 << 20])
def test_neighbours(corpus, bucket_bytes, monkeypatch):
    monkeypatch.setattr(D, "BUCKET_BYTES", bucket_bytes)
    monkeypatch.setattr(D.buckets, "__defaults__", (bucket_bytes,))
    rows = sorted({(r.doc_id is not None, r.doc_id or 0, r.text or "") for r in corpus.filter("doc_id IS NULL OR doc_id NOT IN (5, 12)").collect()})
    got = sorted(D.neighbour_query(corpus.filter("doc_id IS NULL OR doc_id NOT IN (5, 12)")).collect(), key=lambda r: (r.doc_id is not None, r.doc_id))
    assert [r.doc_id for r in got] == [k if there else None for there, k, _ in rows]
    for r, (_, _, t), (_, _, u) in zip(got, rows, rows[1:] + rows[:1], strict=True):
        n = len(t) // 4
        edited = t[: len(t) - n] + u[:n]
        a, b, c = D.prints(pa.array([t, edited, u]))
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), a, b)
        assert (r.near_edited, r.near_next) == (D.likeness([a], [b])[0], D.likeness([a], [c])[0])


def test_repeated_rows_one_row_and_none(corpus, nothing):
    assert D.neighbour_query(corpus).count() == corpus.count() and D.neighbour_query(nothing).count() == 0
    [one] = D.neighbour_query(corpus.filter("doc_id = 0")).collect()
    assert one.near_next == 1.0
    assert D.fingerprints(corpus).count() == corpus.count()
