"""Main text of web pages with a linear-chain conditional random field.

The blocks of a page are a sequence, each main text or not.  Features are the
elements a block lies in, the words of their class and id attributes, and
measures of its text; neighbours are tied by transition weights.  Weights come
from labelled pages by gradient ascent on the conditional likelihood (forward
and backward sums in numpy), labels of a page from Viterbi decoding.

Labelled pages.  The table has none, so two kinds are made from a sample of
`SAMPLE` pages, chosen by a hash.  Pages with landmarks of HTML label
themselves: what lies in article or main, but not in an element or class for
menus, notices and the like, is main text.  The blocks of these pages are then
set again in layouts of many kinds, with and without landmarks, with comments,
forms, notices and side bars among them, whose labels are known.

Defined results: a null or empty page, and one without main text, has the empty
text; tags that are never closed and other errors of markup are read like a
browser does, roughly; repeated rows get equal results; other columns are not
looked at.
"""

from __future__ import annotations

import itertools
import random
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from html import escape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pages import Block, Node, blocks_of
from .shared import small_batches
from .words import blocks, loose

#: Labelled pages at most, layouts of each, blocks of a page that are learnt from, weights.
SAMPLE, LAYOUTS, LONGEST, SIZE = 300, 4, 200, 1 << 15
STEPS, RATE, DECAY = 200, 0.1, 1e-5
#: Bytes of the largest page that is learnt from (all are decoded), and of pages decoded at once.
LARGEST, BLOCK_BYTES = 1 << 20, 4 << 20

# Elements and class words that say what a part of a page is.
MAIN_TAGS = frozenset("article main".split())
OTHER_TAGS = frozenset("nav aside footer form button select option textarea fieldset head title menu dialog".split())
OTHER_WORDS = frozenset("ad ads advert advertisement banner sponsor sponsored promo cookie cookies consent notice alert newsletter subscribe subscription share sharing social related recommended sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar comment comments disqus reply replies respond widget popup modal login signup search pagination toolbar copyright legal".split())
MAIN_WORDS = ["content", "post-content", "entry-content", "article-body", "post", "story", "story-body", "body-text", "main-content", "text", "entry", "page-content", "articleBody", "rich-text"]
PLAIN_WORDS = ["container", "wrapper", "row", "col", "page", "inner", "box", "layout", "grid", "outer", "section", "block"]


def features(page: list[Block]) -> list[tuple[list[int], Node | None]]:
    """Numbers below SIZE of each block's own features, and the element it lies in, whose features are those of `around`."""
    n, out = len(page), []
    title = next((b.text for b in page if b.node and b.node.tag == "title"), "")
    for i, b in enumerate(page):
        last = list(itertools.islice(b.up(), 2))
        own = b.node.own if b.node else ""
        words = b.text.split(" ")
        share = b.linked / max(1, len(b.text))
        size = min(7, len(words).bit_length())
        f = {"bias", f"own {own}", f"words {size}", f"links {round(4 * share)}", f"own {own} words {size}", f"own {own} links {share > 0.5}"}
        f.update(f"last {x.tag}" for x in last)
        f.update(f"near {w}" for x in last for w in x.names)
        f.add(f"end {b.text[-1] in '.!?…\"”»:;'}")
        f.add(f"commas {min(3, b.text.count(','))}")
        f.add(f"digits {sum(c.isdigit() for c in b.text[:200]) > 0.2 * min(200, len(b.text))}")
        f.add(f"place {4 * i // n}")
        if "©" in b.text:
            f.add("copyright")
        if title and own != "title" and b.text[:40] == title[:40]:
            f.add("title")
        for name, j in (("before", i - 1), ("after", i + 1)):
            if 0 <= j < n:
                f.add(f"{name} {page[j].node.own if page[j].node else ''}")
                f.add(f"{name} words {len(page[j].text) // 40 > 0}")
            else:
                f.add(f"{name} none")
        out.append(([_number(x) for x in f], b.node))
    return out


def around(node: Node | None) -> list[int]:
    """Numbers of the features of an element and those it lies in: each name and class word once."""
    return [_number(x) for up in (node.up() if node else ()) for x in up.fresh]


_NUMBERS: dict[str, int] = {}


def _number(feature: str) -> int:
    found = _NUMBERS.get(feature)
    if found is None:
        if len(_NUMBERS) > 200_000:
            _NUMBERS.clear()
        found = _NUMBERS[feature] = zlib.crc32(feature.encode("utf-8")) % SIZE
    return found


def landmarks(page: list[Block]) -> list[int] | None:
    """Labels of the blocks of a page that has landmarks."""
    if not any(t in MAIN_TAGS for b in page for t, _ in b.path):
        return None
    return [int(any(t in MAIN_TAGS for t, _ in b.path) and not any(t in OTHER_TAGS or OTHER_WORDS.intersection(names) for t, names in b.path)) for b in page]


def layout(rng: random.Random, main: list[str], other: list[str]) -> tuple[str, list[str]]:
    """A page around the texts of `main`, and which of its blocks are main text."""
    pick = lambda: escape(rng.choice(other)) if other else "…"
    words = lambda n: " ".join(pick().split()[:n])
    links = lambda n: "".join(f'<li><a href="/x">{words(rng.randint(1, 3))}</a></li>' for _ in range(n))
    name = lambda *x: f'{rng.choice(["class", "class", "id"])}="{rng.choice(x)}"'
    plain = lambda: f'<div class="{rng.choice(PLAIN_WORDS)}">'
    parts = {
        "menu": lambda: rng.choice([f"<nav><ul>{links(rng.randint(3, 8))}</ul></nav>", f"<div {name('menu', 'navbar', 'main-nav', 'navigation', 'topbar')}><ul>{links(rng.randint(3, 8))}</ul></div>", f"<ul {name('breadcrumb', 'breadcrumbs', 'menu')}>{links(3)}</ul>"]),
        "header": lambda: rng.choice([f"<header><p>{words(4)}</p><a href='/'>{words(2)}</a></header>", f"<div {name('header', 'site-header', 'masthead')}><div>{words(5)}</div><p>{words(9)}</p></div>"]),
        "advert": lambda: f"<div {name('ad', 'ads', 'advert', 'advertisement', 'banner', 'sponsored', 'promo', 'ad-slot')}>{rng.choice([pick(), f'<p>{pick()}</p>', f'<a href=/y>{pick()}</a>'])}</div>",
        "notice": lambda: f"<div {name('notice', 'cookie-notice', 'cookie-banner', 'consent', 'alert', 'popup', 'modal', 'gdpr')}><p>{pick()}</p><button>{words(1)}</button></div>",
        "side": lambda: rng.choice([f"<aside><h3>{words(2)}</h3><p>{pick()}</p><ul>{links(4)}</ul></aside>", f"<aside {name('sidebar', 'widget')}><p>{pick()}</p></aside>", f"<div {name('sidebar', 'widget', 'related', 'recommended', 'side')}><h4>{words(3)}</h4><p>{pick()}</p><ul>{links(3)}</ul></div>"]),
        "form": lambda: f"<form {name('newsletter', 'subscribe', 'search', 'login', 'signup')}><label>{words(3)}</label><input name=q><p>{words(8)}</p><button>{words(1)}</button></form>",
        "share": lambda: f"<div {name('share', 'social', 'sharing', 'tags')}><a href=/s>{words(1)}</a> <a href=/t>{words(1)}</a></div>",
        "comments": lambda: rng.choice([f"<section {name('comments', 'reader-comments', 'comment-list', 'discussion', 'responses')}>", f"<div {name('comments', 'disqus', 'comment-section', 'replies', 'reader-comments')}>"]) + f"<h3>{words(2)}</h3>" + "".join(rng.choice(["<div class=comment><p>{}</p></div>", "<article class=comment><p>{}</p></article>", "<li class=reply>{}</li>", "<p class=comment>{}</p>", "<p>{}</p>"]).format(pick()) for _ in range(rng.randint(1, 5))),
        "footer": lambda: rng.choice([f"<footer>&copy; {words(3)} &middot; {pick()}</footer>", f"<footer><p>{pick()}</p><ul>{links(3)}</ul></footer>", f"<div {name('footer', 'site-footer', 'copyright', 'legal')}><p>{pick()}</p></div>"]),
    }

    def part(kind: str) -> str:
        made = parts[kind]()
        if kind == "comments":
            made += "</section>" if made.startswith("<section") else "</div>"
        return made

    def block(i: int, text: str) -> str:
        text = escape(text)
        if not i and rng.random() < 0.8:
            return f"<{(h := rng.choice(['h1', 'h1', 'h2']))}>{text}</{h}>"
        kind = rng.random()
        if kind < 0.75:
            return rng.choice([f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}<br>", f'<p class="{rng.choice(PLAIN_WORDS)}">{text}</p>', f"<div>{text}</div>"])
        if kind < 0.85:
            return f"<ul><li>{text}</li></ul>"
        return rng.choice([f"<blockquote><p>{text}</p></blockquote>", f"<h2>{text}</h2>", f"<table><tr><td>{text}</td></tr></table>", f"<pre>{text}</pre>", f"<section><p>{text}</p></section>"])

    body = []
    for i, text in enumerate(main):
        body.append(block(i, text))
        if i and rng.random() < 0.08:
            body.append(part(rng.choice(["advert", "side", "share", "form", "notice"])))
    inside = [part(k) for k in ("share", "comments", "form") if rng.random() < 0.2]
    before = [part(k) for k in ("header", "menu", "advert", "notice", "side") if rng.random() < 0.6]
    after = [part(k) for k in ("comments", "side", "advert", "form", "menu", "notice") if rng.random() < 0.4]
    rng.shuffle(before)
    rng.shuffle(after)
    opening, closing = rng.choice([("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"), (f'<div {name(*MAIN_WORDS)}>', "</div>"), (f'<div {name(*MAIN_WORDS)}>', "</div>"), (f'<section {name(*MAIN_WORDS)}>', "</section>"), (f'<article {name(*MAIN_WORDS)}>', "</article>")])
    core = opening + "".join(body) + "".join(inside) + closing
    if rng.random() < 0.5:
        core = plain() + core + "</div>"
    if rng.random() < 0.9:
        after.append(part("footer"))
    if rng.random() < 0.15:  # a page that is nothing but its text
        return core, main
    title = escape((main[0] if main else "…")[:60])
    return f"<!DOCTYPE html><html><head><title>{title}</title></head><body>{''.join(before)}{core}{''.join(after)}</body></html>", main


def labelled(pages: list[str], layouts: int = LAYOUTS, seed: int = 7) -> list[tuple[list[Block], list[int]]]:
    """Pages with landmarks, and the layouts made of them."""
    rng, out, known = random.Random(seed), [], []
    for html in pages:
        page = blocks_of(html)[:LONGEST]
        marks = landmarks(page)
        if marks is not None and any(marks):
            out.append((page, marks))
            known.append(([b.text for b, m in zip(page, marks, strict=True) if m], [b.text for b, m in zip(page, marks, strict=True) if not m]))
    pool = [t for _, other in known for t in other] or ["Lorem ipsum dolor sit amet, consectetur.", "Home", "More news"]
    long = [t for main, _ in known for t in main[1:] if len(t) > 40] or pool
    for main, _ in known or [([f"Lorem ipsum {i} dolor sit amet, consectetur adipiscing elit." for i in range(6)], [])]:
        for _ in range(layouts):
            some = [f"{i} {t}" for i, t in enumerate(main[:40])]  # numbered, so that a block is known by its text
            some = some[: rng.choice([1, 3, 40, 40])]
            html, marked = layout(rng, some, [*rng.choices(pool, k=12), *rng.choices(long, k=12)])
            page = blocks_of(html)[:LONGEST]
            want = {" ".join(t.split()) for t in marked}
            marks = [int(b.text in want and b.path[-1:] != (("title", ()),)) for b in page]
            out.append((page, marks))
    return out


@dataclass
class Field:
    """Weights: of a feature for main text against other, of main text after (other, main)."""

    emission: np.ndarray
    first: float
    step: np.ndarray  # [label before, label]

    def emissions(self, pages: list[list[tuple[list[int], Node | None]]]) -> list[np.ndarray]:
        """The score of each block of some pages (`features`); that of the elements around is made once for each element."""
        every = [x for page in pages for x in page]
        if not every:
            return [np.zeros(0) for _ in pages]
        size = np.array([len(own) for own, _ in every], np.int64)
        total = np.add.reduceat(self.emission[np.array([f for own, _ in every for f in own])], np.cumsum(size) - size)
        known: dict[Node | None, float] = {None: 0.0}
        for i, (_, node) in enumerate(every):
            for new in reversed(list(itertools.takewhile(lambda x: x not in known, node.up() if node else ()))):
                known[new] = known[new.parent] + sum(float(self.emission[_number(x)]) for x in new.fresh)
            total[i] += known[node]
        return np.split(total, np.cumsum([len(p) for p in pages])[:-1])

    def viterbi(self, score: np.ndarray) -> list[int]:
        """The likeliest labels; score: of main text against other, of each block."""
        if not len(score):
            return []
        (a, b), (c, d) = self.step.tolist()
        zero, one, back = 0.0, self.first + float(score[0]), []
        for s in score[1:].tolist():
            back.append((zero < one + c - a, zero + b < one + d))
            zero, one = max(zero + a, one + c), max(zero + b, one + d) + s
        label = int(one > zero)
        out = [label]
        for choice in reversed(back):
            label = int(choice[label])
            out.append(label)
        return out[::-1]


def train(pages: list[tuple[list[Block], list[int]]], steps: int = STEPS, rate: float = RATE, decay: float = DECAY) -> Field:
    """Maximise the conditional likelihood of the labels with Adam."""
    pages = [(p, y) for p, y in pages if p]
    if not pages:
        return Field(np.zeros(SIZE), 0.0, np.zeros((2, 2)))
    count, most = len(pages), max(len(p) for p, _ in pages)
    label, real = np.zeros((count, most), np.int64), np.zeros((count, most), bool)
    owner, column = [], []
    for i, (page, marks) in enumerate(pages):
        label[i, : len(marks)], real[i, : len(marks)] = marks, True
        for t, (own, node) in enumerate(features(page)):
            f = [*own, *around(node)]
            owner += [i * most + t] * len(f)
            column += f
    owner, column = np.array(owner), np.array(column)
    pairs = real[:, 1:]
    seen = np.array([[((label[:, :-1] == i) & (label[:, 1:] == j) & pairs).sum() for j in (0, 1)] for i in (0, 1)])
    total = real.sum()
    theta, m, v = np.zeros(SIZE + 5), 0.0, 0.0
    for it in range(1, steps + 1):
        field = theta[:SIZE]
        step = theta[SIZE : SIZE + 4].reshape(2, 2)
        score = np.bincount(owner, weights=field[column], minlength=count * most).reshape(count, most)
        forward, backward = np.zeros((count, most, 2)), np.zeros((count, most, 2))
        forward[:, 0, 1] = theta[-1] + score[:, 0]
        for t in range(1, most):
            new = np.logaddexp(forward[:, t - 1, 0, None] + step[0], forward[:, t - 1, 1, None] + step[1])
            new[:, 1] += score[:, t]
            forward[:, t] = np.where(real[:, t, None], new, forward[:, t - 1])
        for t in range(most - 2, -1, -1):
            ahead = backward[:, t + 1] + np.stack([np.zeros(count), score[:, t + 1]], 1)
            new = np.logaddexp(step[:, 0] + ahead[:, :1], step[:, 1] + ahead[:, 1:])
            backward[:, t] = np.where(real[:, t + 1, None], new, 0.0)
        z = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        single = np.exp(forward[:, :, 1] + backward[:, :, 1] - z[:, None]) * real
        both = np.zeros((2, 2))
        for i in (0, 1):
            for j in (0, 1):
                log = forward[:, :-1, i] + step[i, j] + backward[:, 1:, j] + (score[:, 1:] if j else 0) - z[:, None]
                both[i, j] = np.exp(np.where(pairs, log, -np.inf)).sum()
        error = ((label * real) - single).reshape(-1)
        grad = np.concatenate([np.bincount(column, weights=error[owner], minlength=SIZE), (seen - both).reshape(-1), [(label[:, 0] - single[:, 0]).sum()]]) / total - decay * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta + rate * (m / (1 - 0.9**it)) / (np.sqrt(v / (1 - 0.999**it)) + 1e-8)
    return Field(theta[:SIZE].copy(), float(theta[-1]), theta[SIZE : SIZE + 4].reshape(2, 2).copy())


def fit(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", sample: int = SAMPLE) -> Field:
    """Train on at most `sample` pages."""
    chosen = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{html_col}`").cast("string").alias("html")).filter(F.octet_length("html") <= LARGEST)
    ids = chosen.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = chosen.join(F.broadcast(ids), "id").groupBy("id").agg(F.min("html").alias("html")).orderBy("id").collect()  # `sample` rows
    return train(labelled([r.html for r in rows]))


def texts(html: list[str | None], field: Field) -> list[str]:
    """The main text of each page."""
    parsed = [blocks_of(h) for h in html]
    scores = field.emissions([features(p) for p in parsed])
    return ["\n".join(b.text for b, label in zip(page, field.viterbi(s), strict=True) if label) for page, s in zip(parsed, scores, strict=True)]


def extract(pages: DataFrame, field: Field, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` and the main text, as `text`, of every page."""
    small_batches(pages.sparkSession)
    keep = ["page_id", "url"] if keep is None else keep
    sent = pages.sparkSession.sparkContext.broadcast(field)  # SIZE weights
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("own"), F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("body"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "body", BLOCK_BYTES):
            yield pa.RecordBatch.from_arrays([loose(block.column(0)), pa.array(texts(block.column(1).to_pylist(), sent.value), pa.string())], ["own", "main"])

    out = rows.mapInArrow(scan, f"own {rows.schema['own'].dataType.simpleString()}, main string")
    return out.select("own.*", F.col("main").alias("text"))


def extraction_query(pages: DataFrame) -> DataFrame:
    found = extract(pages, fit(pages))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
