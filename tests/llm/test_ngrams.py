from __future__ import annotations

import collections
import math
import re
import zlib

import pytest

from orrery.llm import ngrams as D


def tokens(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w] + ["</s>"]


class Brute:
    """The same model, from dictionaries."""

    def __init__(self, texts, n):
        self.n = n
        docs = [tokens(t) for t in texts]
        self.raw = collections.Counter(w for d in docs for w in d)
        self.N, self.V = sum(self.raw.values()), len(self.raw)
        self.c = {n: collections.Counter(tuple((["<s>"] * (n - 1) + d)[i : i + n]) for d in docs for i in range(len(d)))}
        for k in range(n - 1, 0, -1):
            self.c[k] = collections.Counter()
            for g, m in self.c[k + 1].items():
                self.c[k][g[1:]] += m if g[1] == "<s>" else 1
        self.d, self.context = {}, {}
        for k, c in self.c.items():
            f = collections.Counter(c.values())
            self.d[k] = [0.0, 0.5, 0.75, 0.75]
            if f[1] and f[2]:
                y = f[1] / (f[1] + 2 * f[2])
                raw = [1 - 2 * y * f[2] / f[1], 2 - 3 * y * f[3] / f[2], 3 - 4 * y * f[4] / f[3] if f[3] else 0.75]
                self.d[k] = [0.0, *(min(max(x, 0.05), j + 0.95) for j, x in enumerate(raw))]
            self.context[k] = collections.defaultdict(lambda: [0, 0, 0, 0])
            for g, m in c.items():
                self.context[k][g[:-1]][0] += m
                self.context[k][g[:-1]][min(m, 3)] += 1

    def p(self, word, before):
        out = 1 / (self.V + 1)
        for k in range(1, self.n + 1):
            h = tuple(before[len(before) - k + 1 :]) if k > 1 else ()
            if h in self.context[k]:
                total, *n = self.context[k][h]
                c = self.c[k][(*h, word)]
                out = max(c - self.d[k][min(c, 3)], 0) / total + sum(x * y for x, y in zip(self.d[k][1:], n, strict=True)) / total * out
        return out

    def score(self, text):
        s = ["<s>"] * (self.n - 1) + tokens(text)
        at = range(self.n - 1, len(s))
        return len(at), sum(self.raw[s[i]] > 0 for i in at), sum(math.log10((self.raw[s[i]] + 1) / (self.N + self.V + 1)) for i in at), sum(math.log10(self.p(s[i], s[i - self.n + 1 : i])) for i in at)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_equals_brute_force(corpus, order, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_BYTES", 2000)
    rows = [(r.doc_id, r.text) for r in corpus.collect()]
    held = lambda k: k is not None and zlib.crc32(str(k).encode()) % 7 == 2
    model = Brute([t for k, t in rows if not held(k)], order)
    got = D.lm_query(corpus, order).collect()
    assert len(got) == len(rows)
    texts = {k: t for k, t in rows if k != 12}
    for r in got:
        assert r.held_out == held(r.doc_id) and r.train_tokens == model.N
        if r.doc_id in texts:
            n, known, base, own = model.score(texts[r.doc_id])
            assert (r.n_tokens, r.n_known) == (n, known) and r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(own, rel=1e-9)


def test_probabilities_add_up(corpus):
    """Over all words after a context: one, with the unknown word."""
    model = Brute([r.text for r in corpus.collect()], 2)
    for before in (["w1"], ["<s>"], ["never seen"]):
        assert sum(model.p(w, before) for w in model.raw) + model.p("unknown word", before) == pytest.approx(1.0)


def test_without_training_text(corpus, nothing):
    model = D.fit(nothing)
    assert (model.tokens, model.vocabulary) == (0, 0)
    assert {(r.score, r.base_score) for r in D.score(corpus, model).collect()} == {(0.0, 0.0)}
    assert D.score(nothing, model).count() == 0
    model.delete()


def test_query_looks_at_two_words_before(spark):
    """The registered model tells "a b c" from "x b c", whose last two words are the same."""
    rows = [(k, t) for k, t in enumerate(["a b c", "x b d"] * 20)]
    score = {r.doc_id: r.score for r in D.lm_query(spark.createDataFrame([*rows, (100, "a b c"), (101, "a b d")], "doc_id long, text string")).collect()}
    assert score[100] > score[101] + 0.1
