from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from orrery.llm import toxicity as D


def _texts(n, seed):
    rng = random.Random(seed)
    bad = ["dreck", "scheusal", "fiesling"]
    rows = []
    for i in range(n):
        w = [f"{rng.choice('abcdefgh')}{rng.randrange(300)}" for _ in range(rng.randint(5, 60))]
        toxic = rng.random() < 0.15
        for _ in range(rng.randint(1, 3) if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(bad) + rng.choice(["", "e", "s", "."]))
        rows.append((i, " ".join(w), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    rows = _texts(1500, 1)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(9000, None, "x"), (9001, "", "x"), (None, "dreck dreck", "x"), (3, rows[3][1], "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 2] + [(8, None), (None, 1)], "doc_id long, toxic int")
    return rows, docs.cache(), labels.cache()


def test_held_out_texts(tables):
    import zlib

    rows, docs, labels = tables
    got = {r.doc_id: r for r in D.toxicity_query(docs, labels).collect()}
    assert D.toxicity_query(docs, labels).count() == docs.count()
    for i, _, _ in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= got[i].score <= 1 and got[i].predicted == int(got[i].score >= 0.5)
    held = [(got[i].score, y) for i, _, y in rows if got[i].held_out]
    pairs = [(a > b) + (a == b) / 2 for a, x in held if x for b, y in held if not y]
    assert np.mean(pairs) > 0.97
    assert np.mean([(s >= 0.5) == bool(y) for s, y in held]) > 0.95
    assert got[9000].score == got[9001].score and got[9000].predicted == 0
    kept = D.drop_toxic(docs, D.fit(docs, labels))
    assert kept.schema == docs.schema and kept.filter("doc_id IN (9000, 9001)").count() == 2


def test_negatives_are_not_needed(tables):
    """Labels of 0 only set the prior; with the prior given they change nothing."""
    _, docs, labels = tables
    a = D.fit(docs, labels, prior=0.15)
    b = D.fit(docs, labels.filter("toxic = 1"), prior=0.15)
    assert (a.names == b.names).all() and np.allclose(a.weights, b.weights)


def test_no_examples_and_no_texts(tables):
    _, docs, labels = tables
    c = D.fit(docs, labels.filter("false"))
    assert c.scores(pa.array(["a b", None]))[0] < 0.5
    assert D.toxicity_query(docs.filter("false"), labels).count() == 0


def test_risk_that_goes_below_zero_is_undone():
    """Positives among the unlabelled only: without the correction the weights would grow without end."""
    one = np.array([7], np.uint64)
    c = D.train([one] * 20, [one] * 20 + [np.zeros(0, np.uint64)] * 20, 0.5)
    assert np.isfinite(c.weights).all() and np.abs(c.weights).max(initial=0) < 50


def test_a_feature_there_twice_is_another():
    document, feature, _ = D.features(pa.array(["abcd abcd ef"]))
    _, f = D.distinct(document, feature)
    assert len(f) == len(set(f.tolist())) == 5  # abcd and its head, each once and as "twice"; ef


def test_gradient_of_both_branches():
    """Against differences of the risk, where the estimate on negatives is above and below zero."""
    rng = np.random.default_rng(0)
    row = np.repeat(np.arange(30), 3)
    column = np.concatenate([rng.integers(0, 4, 30), rng.integers(2, 6, 60)])
    theta = np.array([2.0, 1.5, 0.3, -0.5, -1.0, -2.0, 0.1])
    seen = set()
    for prior in (0.05, 0.9):
        negative = D.risk(theta, row, column, 10, 20, prior)[2]
        seen.add(negative >= 0)
        for i in range(7):
            step = np.eye(7)[i] * 1e-6
            slope = (D.risk(theta + step, row, column, 10, 20, prior)[0] - D.risk(theta - step, row, column, 10, 20, prior)[0]) / 2e-6
            assert D.risk(theta, row, column, 10, 20, prior)[1][i] == pytest.approx(slope, abs=1e-7)
    assert seen == {True, False}


def test_correction_stops_what_the_plain_risk_memorises():
    """Positives known by features that no unlabelled text has: the plain estimate of the risk on negatives falls far below zero."""
    positive = [np.array([i // 10 + 1], np.uint64) for i in range(30)]
    unlabelled = [np.zeros(0, np.uint64)] * 300
    found = {}
    for corrected in (True, False):
        c = D.train(positive, unlabelled, 0.5, corrected=corrected, decay=0.0)
        at = np.searchsorted(c.names, [p[0] for p in positive])
        found[corrected] = D.risk(np.append(c.weights, c.bias), np.arange(30), at, 30, 300, 0.5)[2]
    assert found[False] < -0.4 and found[True] > -0.1


def test_features_speak_for_and_against():
    """A word that toxic texts have less often than others lowers a score."""
    rng = np.random.default_rng(1)
    text = lambda share_bad, share_good: np.array([x for x, s in ((1, share_bad), (2, share_good)) if rng.random() < s], np.uint64)
    c = D.train([text(0.9, 0.1) for _ in range(300)], [text(0.1, 0.8) for _ in range(600)], 0.1)
    assert c.weights[c.names == 1] > 0 > c.weights[c.names == 2]


def test_very_long_and_repeated_texts(spark):
    docs = spark.createDataFrame([(1, "word " * 400_000), (2, "x" * 1_000_000), (3, "a"), (3, "a")], "doc_id long, text string")
    c = D.Classifier(np.zeros(0, np.uint64), np.zeros(0), 0.0, 0.5)
    assert [r.score for r in D.score(docs, c).collect()] == [0.5] * 4
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert all(r.predicted == int(r.score >= 0.5) for r in D.toxicity_query(docs, labels).collect())
    assert D.drop_toxic(docs, c).count() == 0  # a score at the threshold is rejected
