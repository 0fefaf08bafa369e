from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from common import SF

from orrery.llm import repeats as D
from orrery.llm.arrays import forget

PATTERN = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, n):
    """(id, text) -> (n_words, n_removed, kept words) of each row."""
    least = {}
    for k, t in rows:
        w = PATTERN.findall(t or "")
        for i in range(len(w) - n + 1) if k is not None else ():
            s = tuple(w[i : i + n])
            least[s] = min(least.get(s, k), k)
    out = []
    for k, t in rows:
        w = PATTERN.findall(t or "")
        gone = set()
        for i in range(len(w) - n + 1) if k is not None else ():
            if least[tuple(w[i : i + n])] < k:
                gone.update(range(i, i + n))
        out.append((k, len(w), len(gone), [x for i, x in enumerate(w) if i not in gone]))
    return out


@pytest.mark.parametrize(("n", "options"), [(13, {}), (3, {"block_bytes": 400, "group_suffixes": 50}), (2, {"block_bytes": 3000, "group_suffixes": 7})])
def test_equals_brute_force(corpus, n, options):
    rows = [(r.doc_id, r.text) for r in corpus.collect()]
    want = sorted(((k, w, g, hashlib.sha256(" ".join(x).encode()).hexdigest()) for k, w, g, x in brute(rows, n)), key=repr)
    got = D.remove_repeats(corpus, min_words=n, digest=True, **options).collect()
    assert sorted((tuple(r) for r in got), key=repr) == want
    kept = D.remove_repeats(corpus, min_words=n, **options)
    assert kept.schema == corpus.schema
    text = lambda x: sorted(x, key=repr)
    assert text((r.doc_id, PATTERN.findall(r.text or "")) for r in kept.collect()) == text((k, x) for k, _, _, x in brute(rows, n))
    untouched = [x for x, (_, _, g, _) in zip(rows, brute(rows, n), strict=True) if not g]
    assert not Counter(untouched) - Counter((r.doc_id, r.text) for r in kept.collect())
    left = D.remove_repeats(corpus, min_words=n, drop_emptied=True, **options).count()
    assert left == sum(1 for _, w, g, _ in brute(rows, n) if not g or g < w)


def test_repeated_row_loses_what_a_smaller_document_of_another_block_has(spark):
    passage = " ".join(f"p{i}" for i in range(15))
    rows = [(9, f"head {passage} tail"), (9, f"head {passage} tail"), (1, passage + " z" * 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = D.remove_repeats(docs, digest=True, block_bytes=300).collect()
    assert sorted((r.id, r.n_words, r.n_removed) for r in got) == sorted((k, w, g) for k, w, g, _ in brute(rows, 13))


def test_deeper_prefixes_are_used(corpus):
    rows = corpus.selectExpr("doc_id AS id", "coalesce(text, '') AS body")
    split = D.prefixes(rows, D.survey(rows, 3, 3000), 3, 20, 3000)
    assert split.groups >= D.LEAST_GROUPS and split.heavy


def all_maximal(rows, n):
    """(words, occurrences, smallest id, word there) of each maximal repeat, from all substrings."""
    seen, docs = {}, [(k, PATTERN.findall(t or "")) for k, t in rows if k is not None]
    for d, (k, w) in enumerate(docs):
        for i in range(len(w)):
            for j in range(i + n, len(w) + 1):
                seen.setdefault(tuple(w[i:j]), []).append((k, i, (w[i - 1] if i else ("start", d, i)), (w[j] if j < len(w) else ("end", d))))
    return sorted((len(x), len(o), *min((k, i) for k, i, _, _ in o)) for x, o in seen.items() if len(o) > 1 and len({a for _, _, a, _ in o}) > 1 and len({b for _, _, _, b in o}) > 1)


@pytest.mark.parametrize(("n", "options"), [(3, {}), (2, {"block_bytes": 300, "group_suffixes": 7}), (4, {"block_bytes": 3000, "group_suffixes": 50})])
def test_maximal_repeats_equal_brute_force(spark, n, options):
    rng = random.Random(n)
    texts = [" ".join(rng.choices("abcd", k=rng.randint(0, 25))) for _ in range(25)]
    texts += [texts[3], texts[4] + " e", "e " + texts[3], "a a a a a a a a a a a", None, texts[7]]
    rows = list(enumerate(texts)) + [(None, texts[3]), (5, texts[5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = D.maximal_repeats(docs, min_words=n, depth=40, **options).collect()
    assert not any(r.goes_on for r in got)
    assert sorted((r.n_words, r.occurrences, r.id, r.word) for r in got) == all_maximal(rows, n)
    cut = D.maximal_repeats(docs, min_words=n, depth=n + 2, **options).collect()
    short = sorted((r.n_words, r.occurrences, r.id, r.word) for r in cut if not r.goes_on)
    assert short == [x for x in all_maximal(rows, n) if x[0] < n + 2] and any(r.goes_on for r in cut)


def test_nodes_are_those_of_the_suffix_tree():
    rng = np.random.default_rng(3)
    for _ in range(50):
        suffixes = [tuple(rng.integers(1, 3, rng.integers(1, 7))) for _ in range(rng.integers(1, 12))]
        columns = [np.array([x[j] if j < len(x) else 0 for x in suffixes], np.uint64) for j in range(6)]
        order, common = D.sort_suffixes(columns)
        got = {(d, tuple(sorted(order[a:b].tolist()))) for d, begin, end in D.internal_nodes(common, 1, 6) for a, b in zip(begin.tolist(), end.tolist(), strict=True)}
        want = set()
        for x in {s[:d] for s in suffixes for d in range(1, 7) if d <= len(s)}:
            below = [i for i, s in enumerate(suffixes) if s[: len(x)] == x]
            ahead = [suffixes[i][len(x)] if len(suffixes[i]) > len(x) else ("end", i) for i in below]
            if len(below) > 1 and (len(set(ahead)) > 1 or len(x) == 6):
                want.add((len(x), tuple(below)))
        assert got == want


def test_texts_do_not_depend_on_their_neighbours(spark):
    passage = " ".join(f"p{i}" for i in range(15))
    rows = [(1, passage), (2, "  \t"), (3, f"   a {passage}  c"), (4, f"\n{passage} d "), (5, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    outs = [sorted(tuple(r) for r in D.remove_repeats(docs.repartition(n, "doc_id") if n else docs.coalesce(1), block_bytes=size).collect()) for n in (0, 1, 7) for size in (30, 10_000)]
    assert all(o == outs[0] for o in outs) and outs[0][2] == (3, "   a c") and outs[0][3] == (4, "\nd ")


@pytest.mark.parametrize("groups", [64, 500, 4000])
def test_what_is_sent_does_not_grow_with_the_groups(spark, groups):
    """Numbers of words instead of names, ids with the suffixes: more groups only cost the frames of the blobs."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id AS id", "coalesce(text, '') AS body").coalesce(1)
    found = D.survey(docs, 13, D.BLOCK_BYTES)
    split = D.Prefixes({}, 1, 13, groups)
    batch = pa.Table.from_pandas(docs.toPandas()).combine_chunks().to_batches()[0]
    _, sent = D._leaves(D.Block(batch, 13), found, split, 16)
    size = sum(len(blob) for _, blob in sent)
    rows = sum(D.Leaves.of([blob], 16).ids.size for _, blob in sent)
    forget()
    assert rows > 5000 and size < 40 * rows + 250 * len(sent)


def test_places_of_a_group_go_back_blob_by_blob():
    rng = np.random.default_rng(3)
    blob, place = rng.integers(0, 40, 500), rng.integers(0, 9000, 500).astype(np.uint32)
    got = [(i, x.tolist()) for i, x in D._by_blob(blob, place)]
    assert got == [(i, sorted(place[blob == i].tolist())) for i in sorted(set(blob.tolist()))]
    assert not list(D._by_blob(blob[:0], place[:0]))


def test_empty_table(nothing):
    assert D.maximal_repeats(nothing).count() == 0
    assert D.remove_repeats(nothing, digest=True).count() == 0 and D.remove_repeats(nothing).columns == nothing.columns


def test_sql_of_the_query(same):
    from orrery.llm import registry

    same(registry.QUERIES["op8_substring_dedup"], registry.SQL["op8_substring_dedup"])
    same(registry.QUERIES["op2_decontaminate"], registry.SQL["op2_decontaminate"])
    same(registry.QUERIES["op1_perspective_rotation"], registry.SQL["op1_perspective_rotation"])
