"""Blocks of text of a web page: a forgiving reader of HTML.

A block is the text between two borders of block elements.  Inline elements and
line breaks do not end one.  Text of scripts, styles, drawings and comments is
no text.

The page is read once from the left, from one mark to the next, with quoted
values of any length.  Open elements are chains of nodes that share their
ancestors, and where the open elements of a name stand is kept beside them, so
time and memory grow with the length of a page, however deep its elements nest.

Defined results: a quote that is never closed ends with its tag; a comment that
is never closed ends with the page, as a script does; a drawing that is never
closed hides nothing but its tag; a page that ends within a tag has it as text.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

# Element names of the HTML standard, by how they are laid out.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never markup: hidden, or shown as text.
RAW, PLAIN = frozenset("script style noscript iframe".split()), frozenset("textarea title".split())
#: Elements that are no text with all they hold.
NESTED = frozenset("svg template object".split())
#: What the opening of an element closes, if it is open: its own kind, and these.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements beyond which an opening closes nothing.
SCOPE = frozenset("ul ol table div section article main body td th li".split())
#: Attributes that say what an element is for.
TELLING = frozenset("class id role itemprop".split())

_TAG = re.compile(r"[a-zA-Z][^\s/>]*")
_GAP = re.compile(r"[\s/]*")
_ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*)(\s*=\s*)?")
_UNQUOTED = re.compile(r"[^\s>]*")
_COMMENT_END = re.compile(r"--!?>")
_WORD = re.compile(r"[a-z]+")
_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW | PLAIN}
_EITHER = {tag: re.compile(rf"<(/?){tag}(?=[\s/>])", re.I) for tag in NESTED}


class Node:
    """An open element.  fresh: what it tells of the blocks within that no element around it does."""

    __slots__ = ("tag", "names", "parent", "own", "fresh")

    def __init__(self, tag: str, names: tuple[str, ...], parent: Node | None, fresh: tuple[str, ...] = ()):
        self.tag, self.names, self.parent, self.fresh = tag, names, parent, fresh
        self.own: str = tag if tag not in INLINE else parent.own if parent else ""  # the innermost element that is not inline

    def up(self) -> Iterator[Node]:
        """This one and those around it, outwards."""
        node: Node | None = self
        while node is not None:
            yield node
            node = node.parent


@dataclass
class Block:
    text: str
    node: Node | None  # the element it lies in
    linked: int  # characters of links

    def up(self) -> Iterator[Node]:
        return self.node.up() if self.node else iter(())

    @property
    def path(self) -> tuple[tuple[str, tuple[str, ...]], ...]:
        """(element, words of its telling attributes), from the root."""
        return tuple((x.tag, x.names) for x in self.up())[::-1]


def _past_comment(html: str, at: int) -> int:
    """Where the declaration, comment or instruction that begins here ends."""
    if html.startswith("<!--", at):
        for short in ("<!-->", "<!--->"):
            if html.startswith(short, at):
                return at + len(short)
        end = _COMMENT_END.search(html, at + 4)
        return end.end() if end else len(html)
    if html.startswith("<![CDATA[", at) and (end := html.find("]]>", at)) >= 0:
        return end + 3
    return _past(html, at)


def _past(html: str, at: int) -> int:
    end = html.find(">", at)
    return end + 1 if end >= 0 else len(html)


class _Page:
    """A page with what is worth knowing once."""

    def __init__(self, html: str):
        self.html = html
        self.last_quote = {q: html.rfind(q) for q in "\"'"}
        self.last_end: dict[str, int] = {}

    def attributes(self, at: int) -> tuple[tuple[str, ...], int, bool] | None:
        """Of the tag whose name ends here: words of its telling attributes, where it ends, whether it closes itself; none if the page ends first."""
        html, words = self.html, []
        while True:
            gap = _GAP.match(html, at)
            at = gap.end()
            if at >= len(html):
                return None
            if html[at] == ">":
                return tuple(dict.fromkeys(words)), at + 1, gap[0].endswith("/")
            name = _ATTRIBUTE.match(html, at)
            at = name.end()
            if name[2] is None:
                continue
            quote = html[at : at + 1]
            if quote in self.last_quote:
                end = html.find(quote, at + 1) if at < self.last_quote[quote] else -1
                if end < 0:
                    end = html.find(">", at)
                    return (tuple(dict.fromkeys(words)), end + 1, False) if end >= 0 else None
                value, at = html[at + 1 : end], end + 1
            else:
                value = _UNQUOTED.match(html, at)[0]
                at += len(value)
            if name[1].lower() in TELLING:
                words += _WORD.findall(value.lower())

    def past_nested(self, tag: str, at: int) -> int:
        """Where the element of this tag that has just been opened ends; `at` if it never does."""
        if tag not in self.last_end:
            self.last_end[tag] = max((m.start() for m in _EITHER[tag].finditer(self.html) if m[1]), default=-1)
        if at > self.last_end[tag]:
            return at
        depth, end = 1, at
        for m in _EITHER[tag].finditer(self.html, at):
            if m[1]:
                depth, end = depth - 1, _past(self.html, m.end())
            elif not self.html[m.start() : _past(self.html, m.end())].endswith("/>"):
                depth += 1
            if not depth:
                break
        return end


class _Open:
    """The open elements."""

    def __init__(self):
        self.stack: list[Node] = []
        self.places: dict[str, list[int]] = defaultdict(list)  # of the open elements of each name
        self.told: dict[str, int] = defaultdict(int)

    def push(self, tag: str, names: tuple[str, ...]) -> None:
        says = (f"in {tag}", *(f"name {w}" for w in names))
        fresh = tuple(s for s in says if not self.told[s])
        for s in says:
            self.told[s] += 1
        self.places[tag].append(len(self.stack))
        self.stack.append(Node(tag, names, self.stack[-1] if self.stack else None, fresh))

    def shrink(self, size: int) -> None:
        while len(self.stack) > size:
            node = self.stack.pop()
            self.places[node.tag].pop()
            for s in (f"in {node.tag}", *(f"name {w}" for w in node.names)):
                self.told[s] -= 1

    def innermost(self, tags) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def closed_by(self, tag: str) -> None:
        """The opening of a block element closes the innermost of its kinds, unless an element of the scope stands between."""
        kinds = CLOSES.get(tag, set())
        place = self.innermost({"p", *kinds})
        if place >= 0 and place > self.innermost(SCOPE - kinds):
            self.shrink(place)


def blocks_of(html: str | None) -> list[Block]:
    """All blocks that have text, in page order, white space within as one space."""
    html = html or ""
    page, held, out = _Page(html), _Open(), []
    parts: list[str] = []
    node: Node | None = None
    linked = 0

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, node, linked))
            parts, linked = [], 0

    def add(raw: str) -> None:
        nonlocal node, linked
        if not raw:
            return
        text = unescape(raw) if "&" in raw else raw
        if not parts:
            if text.isspace():
                return
            node = held.stack[-1] if held.stack else None
        parts.append(text)
        if held.places["a"]:
            linked += len(text)

    at = seek = 0
    while (mark := html.find("<", seek)) >= 0:
        kind = html[mark + 1 : mark + 2]
        if kind in ("!", "?"):
            add(html[at:mark])
            at = seek = _past_comment(html, mark)
            continue
        ends = kind == "/"
        name = _TAG.match(html, mark + 1 + ends)
        if name is None:
            if ends and mark + 2 < len(html):  # an end of nothing
                add(html[at:mark])
                at = seek = _past(html, mark)
            else:
                seek = mark + 1
            continue
        if (said := page.attributes(name.end())) is None:
            break
        add(html[at:mark])
        tag = name[0].lower()
        names, at, closed = said
        seek = at
        if tag == "br":
            if parts:
                parts.append(" ")
        elif ends:
            if tag not in INLINE:
                flush()
            if held.places.get(tag):
                held.shrink(held.places[tag][-1])
        elif tag in RAW:
            end = _END[tag].search(html, at)
            at = seek = _past(html, end.start()) if end else len(html)
        elif tag in NESTED:
            at = seek = at if closed else page.past_nested(tag, at)
        else:
            if tag not in INLINE:
                flush()
                held.closed_by(tag)
            if tag not in VOID and not closed:
                held.push(tag, names)
                if tag in PLAIN:
                    end = _END[tag].search(html, at)
                    seek = end.start() if end else len(html)
    add(html[at:])
    flush()
    return out
