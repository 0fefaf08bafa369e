from __future__ import annotations

import re
import sys

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from orrery.llm import arrays, words

settings.register_profile("any_pace", deadline=None)  # other work may slow a case down
settings.load_profile("any_pace")

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet=" \t\n\x0b\x1c\xa0aAzZ09.-é漢😀", max_size=40)), max_size=8)


@given(TEXTS)
def test_words_are_those_of_the_patterns(texts):
    for kind, pattern in ((words.UNSPACED, r"[^\x20\x09-\x0D]+"), (words.LETTERS, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        found = words.find_words(*words.text_bytes(pa.array(texts, pa.string())), kind, fold=True)
        got = [[found.data[a:b].tobytes().decode() for a, b in zip(found.starts[x:y], found.ends[x:y], strict=True)] for x, y in zip(found.first[:-1], found.first[1:], strict=True)]
        assert got == [re.findall(pattern, re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]


@given(st.lists(st.text(alphabet="ab", min_size=1, max_size=30), min_size=1, max_size=30))
def test_equal_words_and_only_these_have_equal_hashes(some):
    found = words.find_words(*words.text_bytes(pa.array([" ".join(some)])), words.UNSPACED)
    h = found.hashes().tolist()
    assert all((h[i] == h[j]) == (some[i] == some[j]) for i in range(len(some)) for j in range(i))


def test_words_of_any_length():
    base = "x" * 300
    some = [base[:n] for n in (1, 7, 8, 9, 16, 255, 256, 257, 300)] + [base[:299] + "y"]
    h = words.find_words(*words.text_bytes(pa.array([" ".join(some)])), words.UNSPACED).hashes()
    assert len(set(h.tolist())) == len(some)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 13])
def test_run_hashes_depend_on_the_run_alone(n):
    h = np.random.default_rng(n).integers(0, 2**63, 40).astype(np.uint64)
    whole = words.run_hashes(h, n)
    assert len(whole) == 41 - n and all(words.run_hashes(h[i : i + n], n)[0] == whole[i] for i in range(len(whole)))
    assert len(words.run_hashes(h[: n - 1], n)) == 0


@given(st.lists(st.one_of(st.none(), st.text(max_size=50)), max_size=30), st.integers(1, 60))
def test_blocks_keep_rows_and_order(texts, most):
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[i : i + 4], pa.string())], ["t"]) for i in range(0, len(texts), 4)]
    out = list(words.blocks(batches, "t", most))
    assert [t for b in out for t in b.column(0).to_pylist()] == texts
    assert all(b.num_rows == 1 or sum(len((t or "").encode()) for t in b.column(0).to_pylist()) <= most for b in out)


@given(st.lists(st.integers(0, 2**64 - 1), max_size=50))
def test_packed_arrays_come_back(values):
    x = np.sort(np.array(values, np.uint64))
    y = (x & np.uint64(0xFFFF)).astype(np.uint32)
    a, b = arrays.unpack(arrays.pack(arrays.steps(x), y), np.uint64, np.uint32)
    assert (np.cumsum(a, dtype=np.uint64) == x).all() and (b == y).all()


@pytest.mark.parametrize("n", [3, 500, 20_000])
def test_lookup_in_shards(tmp_path, n):
    """Keys with common and rare rows of counts; a shard without a file; keys that are nowhere."""
    uri = f"file://{tmp_path}"
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
    rows = [np.where(rng.random(len(keys)) < 0.8, keys % np.uint64(3), keys % np.uint64(5000)), keys >> np.uint64(62)]
    wide = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    shard = arrays.shard_of(keys, 7)
    for s in range(7):
        mine = shard == s
        if s != 3:
            arrays.write_table(uri, f"t_{s:06d}", keys[mine], [r[mine] for r in rows], wide[mine])
    asked = np.concatenate([keys, keys + np.uint64(1)])
    found, counts, more = arrays.lookup(uri, "t", arrays.shard_of(asked, 7), asked, 2)
    there = np.isin(asked, keys) & (arrays.shard_of(asked, 7) != 3)
    at = np.searchsorted(keys, asked[there])
    assert (found == there).all() and (counts[there] == np.stack([r[at] for r in rows], 1)).all() and (more[there] == wide[at]).all()
    assert not counts[~there].any() and not more[~there].any()
    assert not arrays.lookup(uri, "t", np.zeros(0, np.int64), np.zeros(0, np.uint64), 2)[0].size
    arrays.forget()


@pytest.mark.skipif(sys.version_info < (3, 13), reason="a mapped file holds a descriptor")
def test_files_of_large_tables_stay_mapped(tmp_path):
    """Each block asks all shards in turn; none is mapped anew for the next block."""
    uri, key = f"file://{tmp_path}", np.arange(1, 5, dtype=np.uint64)
    for s in range(400):
        arrays.write_table(uri, f"t_{s:06d}", key, [key])
    arrays.forget()
    shard = np.arange(400)
    seen = []
    for _ in range(3):
        assert arrays.lookup(uri, "t", shard, np.full(400, 3, np.uint64), 1)[1].tolist() == [[3]] * 400
        seen.append(arrays._opened.cache_info().misses)
    assert seen == [400] * 3
    arrays.forget()


def test_row_hashes_are_run_hashes():
    rng = np.random.default_rng(1)
    columns = [rng.integers(0, 2**64, 20, dtype=np.uint64) for _ in range(3)]
    flat = np.stack(columns, 1).reshape(-1)
    assert (words.row_hashes(columns) == words.run_hashes(flat, 3)[::3]).all()
