from __future__ import annotations

import html as H
import itertools
import random
import re
import time

import numpy as np
import pytest
from common import SF

from orrery.llm import extract as D
from orrery.llm.pages import blocks_of


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet(f"{SF}/pages.parquet")


@pytest.fixture(scope="module")
def field(pages):
    return D.fit(pages)


def test_blocks():
    text = lambda h: [b.text for b in blocks_of(h)]
    assert text("<p>a <b>b</b>\n c<br>d<p>e<ul><li>f<li>g</ul>h") == ["a b c d", "e", "f", "g", "h"]
    assert text("x<script>if (a<b) '</p>'</script>y<style>p{}</style>z<!-- <p>no</p> -->") == ["xyz"]
    assert text("<p>1 &lt; 2 &amp; &#233; &eacute;&nbsp;!</p>") == ["1 < 2 & é é !"]
    assert text("<p title='a>b'>c</p><p>d</p></div></p>e<p") == ["c", "d", "e<p"]
    assert text(None) == text("") == text("<p> \n</p><div/>") == []
    assert blocks_of("<table><tr><td>a<td>b</table>")[1].path[-1][0] == "td"
    assert text("<script>never closed <p>x") == [] and len(text("<p>a" * 3000)) == 3000


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    for _ in range(100):
        n = int(rng.integers(1, 8))
        f = D.Field(np.zeros(1), float(rng.normal()), rng.normal(size=(2, 2)))
        s = rng.normal(size=n) * 2
        value = lambda y: y[0] * f.first + sum(a * b for a, b in zip(y, s, strict=True)) + sum(f.step[a, b] for a, b in zip(y, y[1:], strict=False))  # noqa: B023, E731
        assert value(f.viterbi(s)) == pytest.approx(max(value(y) for y in itertools.product((0, 1), repeat=n)))


def test_training_lowers_the_loss_it_should():
    """Labels that a feature decides are learnt."""
    rng = random.Random(0)
    pages = []
    for _ in range(40):
        kinds = [rng.random() < 0.5 for _ in range(6)]
        page = blocks_of("".join(f"<p class={'good' if k else 'bad'}>some words here</p>" for k in kinds))
        pages.append((page, [int(k) for k in kinds]))
    f = D.train(pages)
    assert all(f.viterbi(f.emissions([D.features(p)])[0]) == y for p, y in pages)


def _article(html):
    inner = re.search(r"<article>(.*)</article>", html, re.S)[1]
    parts = (" ".join(H.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner))
    return "\n".join(p for p in parts if p)


def test_articles_of_all_pages(spark, pages, field):
    rows = {r.page_id: r.html for r in pages.collect()}
    got = D.extraction_query(pages).collect()
    assert len(got) == len(rows) and all(r.text == _article(rows[r.page_id]) and r.n_chars == len(r.text) for r in got)


def test_layouts_that_were_not_trained_on(pages, field):
    made = D.labelled([r.html for r in pages.collect()], layouts=2, seed=1234)
    right = found = true = 0
    for page, want in made:
        got = field.viterbi(field.emissions([D.features(page)])[0])
        right += sum(a & b for a, b in zip(got, want, strict=True))
        found, true = found + sum(got), true + sum(want)
    assert right / found > 0.97 and right / true > 0.97


def test_rows_of_all_kinds(spark, pages, field):
    rows = spark.createDataFrame([(1, "u", None, "x"), (2, None, "", "x"), (2, None, "", "x"), (None, "u", "<nav>a</nav>", "x"), (3, "u", "<article><p>" + "long text, " * 50_000 + "</article>", "x")], "page_id long, url string, html string, text string")
    got = D.extract(rows, field).collect()
    assert len(got) == 5 and sorted(len(r.text) for r in got)[:4] == [0, 0, 0, 0] and max(len(r.text) for r in got) > 500_000
    assert D.extraction_query(rows.filter("false")).count() == 0


@pytest.mark.parametrize("quote", ['"', "'"])
def test_long_attributes_are_no_text(quote):
    inside = "<b>inner</b> > " * 1000
    assert [b.text for b in blocks_of(f"<p data-x={quote}{inside}{quote}>outer</p><p>next</p>")] == ["outer", "next"]


def test_marks_of_all_kinds():
    text = lambda h: [b.text for b in blocks_of(h)]
    assert text("<p>a</p><!--><p>b</p><!-- k --><p>c</p>") == ["a", "b", "c"]
    assert text("<p>a</p><!---><p>b</p><!-- k --!><p>c</p><!-- <p>d") == ["a", "b", "c"]
    assert text("<p>a <![CDATA[ x > y ]]> b</p><?php if (a) ?>c<!DOCTYPE html>") == ["a b", "c"]
    assert text("a < b <3 </> </ x> c") == ["a < b <3 c"]
    assert text("<p class=it's>a</p><a href=/x/>b</a><p id = 'c\">d'>e") == ["a", "b", "e"]
    assert text("<p title=\"never closed>a</p><p>b</p>") == ["a", "b"]
    assert text("a<svg><g><svg><text>no</text></svg></g></svg>b<svg>c<template><p>no</template>d<svg/>e") == ["abcde"]
    assert text("<title>1 <b>2</b></title><textarea><p>x</p></textarea>") == ["1 <b>2</b>", "<p>x</p>"]
    assert text("<SCRIPT>a</scripts>b</Script >c") == ["c"]


@pytest.mark.parametrize("size", [5_000, 1_000_000])
def test_attributes_of_any_length(size):
    inside = ("a > <b>x</b> " * size)[:size]
    assert [b.text for b in blocks_of(f'<p data-x="{inside}">Real text</p>')] == ["Real text"]


@pytest.mark.parametrize("opening", ["<div>x", "<div class=c{}>x", "<b><p>x", "<x-{} id=a{}>x", "<svg>x", "<p title=\"x", "<li>x<x-y>"])
def test_deep_pages_take_time_in_proportion(opening, field):
    def seconds(n):
        made = "".join(opening.format(i, i) for i in range(n))
        began = time.perf_counter()
        blocks = D.features(blocks_of(made))
        field.emissions([blocks])
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(100_000) < 20


def test_scores_of_elements_add_up(field):
    """Scores that are shared between blocks are those of all features of each."""
    page = D.features(blocks_of("<div class='post content'><div class=content><p>a</p><section id=post><p>b <i>c</i></p></section></div><p>d</p></div>e"))
    want = [sum(field.emission[f] for f in own) + sum(field.emission[f] for f in D.around(node)) for own, node in page]
    assert field.emissions([page])[0] == pytest.approx(want)
    assert len(D.around(page[1][1])) == len(set(D.around(page[1][1])))


def test_gradient_is_that_of_the_likelihood():
    """One step of training moves a weight as the brute-force likelihood of all labellings says."""
    page = blocks_of("<h1>a</h1><p>b c d.</p><div>e</div>")
    marks = [0, 1, 1]

    def loss(field):
        s = field.emissions([D.features(page)])[0]
        value = lambda y: y[0] * field.first + sum(a * b for a, b in zip(y, s, strict=True)) + sum(field.step[a, b] for a, b in zip(y, y[1:], strict=False))
        return value(marks) - np.log(sum(np.exp(value(y)) for y in itertools.product((0, 1), repeat=len(s))))

    zero = D.Field(np.zeros(D.SIZE), 0.0, np.zeros((2, 2)))
    base, tiny = loss(zero), 1e-6
    step = D.train([(page, marks)], steps=1, rate=1.0, decay=0.0)  # Adam's first step is the sign of the gradient
    for i in range(2):
        for j in range(2):
            moved = D.Field(zero.emission, 0.0, np.eye(4)[2 * i + j].reshape(2, 2) * tiny)
            slope = (loss(moved) - base) / tiny
            assert np.sign(step.step[i, j]) == pytest.approx(np.sign(slope) if abs(slope) > 1e-5 else step.step[i, j])
    for f in {x for own, _ in D.features(page) for x in own}:
        moved = D.Field(np.eye(1, D.SIZE, f)[0] * tiny, 0.0, zero.step)
        slope = (loss(moved) - base) / tiny
        assert abs(slope) < 1e-5 or np.sign(step.emission[f]) == np.sign(slope)
