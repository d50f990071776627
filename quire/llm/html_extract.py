"""Main text of HTML pages as the maximum-scoring subsequence of their tokens.

The labelled pages that the weights come from are made by this module (labelled_pages), since the tables have no labels for pages.

A page is a sequence of words and tags. A word scores above 0, at most 1: nearly 1 in running text, hardly anything in
menus, adverts, comments and the like. What decides is where it stands: the elements around it, the words of their class
names, how long its block is and how much of it is linked, and whether it stands outside the page's article element. A tag
scores below 0, and farther below if it stands outside the article element and is one that articles hardly have. One linear scan finds the contiguous run of tokens
with the greatest sum: the content region. All that lies outside goes: what stands before, after and around the article.

What is put into an article, such as an advert between two paragraphs or readers' comments at its end, lies inside the region. Elements that may be such an
insert (INSERTS, or any with a class name) are judged as a whole, by their names, their share of the region's words, the share
of linked words, their place in the region, and whether their children are paragraphs or boxes that are alike; headers and footers are not among them: the region alone decides.

All weights come from labelled pages, by logistic regression. The labelled pages are made by labelled_pages: layouts with
the usual parts, in which the article is known. Half of their parts have names that mean nothing, so that the model learns
from structure too. The trained weights are a small table, which goes to the executors with the function.

A null or empty html, and one without words, gives an empty text. Broken markup is read leniently: unknown and
unclosed tags, comments and scripts that never end, bare ``<``; ``/>`` ends an element at once (not a script or the like). Very long pages are read whole in one pass, with time and memory in proportion to
their length, however deep they are nested. Repeated
rows get the same text; an empty table gives an empty result; further columns are carried along, and a column that has the
name of the result is replaced.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import ship, table

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z](?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+>|</?[a-zA-Z][^>]*(?:>|\Z)|[^<]+|<", re.S)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-label)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", re.I)
PART = re.compile(r"[a-zA-Z][a-z]*")

#: Elements whose content is no markup: all up to the end tag, or to the end of the page, is theirs.
RAW = frozenset(("script", "style", "textarea", "title"))
#: Elements whose content is no text.
NO_TEXT = frozenset(("noscript", "template", "svg", "iframe", "canvas", "select", "button"))
NO_TEXT_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|textarea|title)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)(" + "|".join(sorted(NO_TEXT)) + r")(?=[\s/>])(?:(?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*(?:>|\Z))", re.S | re.I)
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
#: Elements that begin and end a block of text.
BLOCKS = frozenset(("address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"))
#: A new one of these ends an open one of the same kind.
SELF_ENDING = frozenset(("p", "li", "dt", "dd", "tr", "td", "th", "option"))
#: A search for an open one of these ends at one of WALLS.
WALLS = frozenset(("ul", "ol", "dl", "table", "article", "section", "div", "body"))
INNER = frozenset(("article", "main"))
#: Elements that hold a text as such; text that stands right in another one is bare.
PLAIN = frozenset(("p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "td", "th", "dt", "dd", "blockquote", "pre", "figcaption", "caption"))
#: The score of a tag that articles have.
LEAST = -0.02
#: Examples that a feature must have to be learned.
LEAST_EXAMPLES = 12
LISTS = frozenset(("ul", "ol", "dl", "menu"))
#: Children by which lists, tables and figures are told from boxes.
ITEMS = frozenset(("tr", "td", "tbody", "thead", "dt", "dd", "img", "figcaption"))
#: Ridge penalty of the weights that judge inserts.
INSERT_PENALTY = 1e-3
#: Elements that may be an insert in an article also without a class name.
INSERTS = frozenset(("aside", "nav", "form", "iframe", "dialog", "menu", "ul", "ol", "div", "section", "fieldset"))


def names_of(tag: str, name: str, inside: bool) -> list[str]:
    """The features of an element: its name and the words of its class, id and role.

    A header or footer inside an article is another thing than one of the page.
    """
    found = [f"{name}@article" if inside and name in ("header", "footer") else name]
    if len(tag) > len(name) + 2:
        for m in ATTRIBUTE.finditer(tag, len(name) + 1):
            if m[1].lower() == "hidden":
                found.append("hidden")
            else:
                found += {f".{x.lower()}" for x in PART.findall(m[2] or m[3] or m[4] or "")}
    return found


def closed(page: str) -> dict[int, int]:
    """For each element of NO_TEXT that has an end tag: where its start tag ends, and where its end tag does."""
    open_: dict[str, list[int]] = {}
    found = {}
    for m in NO_TEXT_TAG.finditer(page):
        if m[3] and not m[2] and not m[0].endswith("/>"):
            open_.setdefault(m[3].lower(), []).append(m.end())
        elif m[2] and open_.get(m[3].lower()):
            found[open_[m[3].lower()].pop()] = m.end()
    return found


class Run:
    """A piece of text or a tag: what the scan sees. of is the number of the element around it, -1 if there is none; text is None for tags."""

    __slots__ = ("of", "name", "text", "words", "block")

    def __init__(self, of, name, text, words, block):
        self.of, self.name, self.text, self.words, self.block = of, name, text, words, block


class Element:
    """An element of the page: the runs from start to stop are its tags and what is between them.

    new: those of its names that no element around it has. So the names of a path are summed from its elements, whatever its depth.
    """

    __slots__ = ("name", "names", "new", "parent", "start", "stop", "inner", "linked", "plain", "kids")

    def __init__(self, name, names, new, parent, above, start):
        self.name, self.names, self.new, self.parent, self.start, self.stop = name, names, new, parent, start, -1
        self.inner = name in INNER or bool(above and above.inner)
        self.linked = name == "a" or bool(above and above.linked)
        self.plain = name in PLAIN or bool(above and above.plain)
        self.kids = {}


class Open:
    """The open elements, and where those of a name, and those that end a search for one, stand among them."""

    def __init__(self):
        self.stack: list[int] = []
        self.at: dict[str, list[int]] = {}
        self.walls: list[int] = []
        self.names: dict[str, int] = {}

    def push(self, i: int, element: Element) -> None:
        self.at.setdefault(element.name, []).append(len(self.stack))
        if element.name in WALLS:
            self.walls.append(len(self.stack))
        self.stack.append(i)
        for n in element.names:
            self.names[n] = self.names.get(n, 0) + 1

    def close(self, k: int, elements: list[Element], upto: int) -> None:
        """Ends the elements from the k-th on: each is looked at once."""
        while len(self.stack) > k:
            element = elements[self.stack.pop()]
            element.stop = upto
            self.at[element.name].pop()
            if element.name in WALLS:
                self.walls.pop()
            for n in element.names:
                self.names[n] -= 1

    def last(self, name: str) -> int:
        found = self.at.get(name)
        return found[-1] if found else -1


def parsed(page: str) -> tuple[list[Run], list[Element]]:
    """The page's texts and tags, with the elements around them, and its elements in order. Time and memory are linear in the page.

    An element of NO_TEXT without an end tag ends at the next block or line break, or with the element around it.
    """
    runs: list[Run] = []
    elements: list[Element] = []
    open_ = Open()
    at, n = 0, len(page)
    inside = 0
    ends: dict[int, int] | None = None
    mute: int | None = None
    top = lambda: open_.stack[-1] if open_.stack else -1

    while at < n:
        m = TOKEN.match(page, at)
        at = m.end()
        t = m[0]
        if t[0] != "<" or len(t) == 1:
            if mute is None:
                runs.append(Run(top(), "", t, len(t.split()), False))
            continue
        named = NAME.match(t)
        if not named:
            continue  # comments, doctypes and the like
        name = named[1].lower()
        if name in BLOCKS or name == "br":
            mute = None
        if t[1] == "/":
            k = open_.last(name)
            if k >= 0:
                inside -= sum(elements[i].name in INNER for i in open_.stack[k:])
                open_.close(k, elements, len(runs) + 1)
                if mute is not None and k < mute:
                    mute = None
        elif name in NO_TEXT:
            mute = None
            if not t.endswith("/>"):
                ends = closed(page) if ends is None else ends
                if at in ends:
                    at = ends[at]
                else:
                    mute = len(open_.stack)
        elif name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = end.end() if end else n
        elif name not in VOID and not t.endswith("/>"):
            if name in SELF_ENDING:
                k = open_.last(name)
                if k >= 0 and (not open_.walls or k > open_.walls[-1]):
                    open_.close(k, elements, len(runs))
            names = tuple(names_of(t, name, inside > 0))
            parent = top()
            above = elements[parent] if parent >= 0 else None
            if above:
                above.kids[name] = above.kids.get(name, 0) + 1
            elements.append(Element(name, names, tuple(x for x in dict.fromkeys(names) if not open_.names.get(x)), parent, above, len(runs)))
            open_.push(len(elements) - 1, elements[-1])
            inside += name in INNER
        runs.append(Run(top(), name, None, 0, name in BLOCKS))
    open_.close(0, elements, len(runs))
    _only_large_ones_are_inner(runs, elements)
    return runs, elements


def _only_large_ones_are_inner(runs: list[Run], elements: list[Element]) -> None:
    """An article element with less than a third of the page's words is no article, but a comment or a teaser."""
    words = [0]
    for r in runs:
        words.append(words[-1] + r.words)
    for e in elements:
        if e.inner:
            above = elements[e.parent].inner if e.parent >= 0 else False
            e.inner = above or e.name in INNER and 3 * (words[e.stop] - words[e.start]) >= words[-1]


def features_around(of: int, elements: list[Element]) -> list[str]:
    """The names of an element and of all around it, each once."""
    found: list[str] = []
    while of >= 0:
        found += elements[of].new
        of = elements[of].parent
    return found


def _sized(words: int) -> str:
    return f"#words{min(words, 64).bit_length()}"


def _linked(linked: int, words: int) -> str:
    return "#links0" if not linked else "#links1" if 2 * linked < words else "#links2"


def described(runs: list[Run], elements: list[Element]) -> list[tuple[int, str, str, str, str] | None]:
    """What each text is scored by: the element around it, and the features of its block and of its place; None for tags.

    A block is what stands between two tags of blocks. #above: before the page's first main heading.
    """
    whole = any(e.inner for e in elements)
    above = any(e.name == "h1" for e in elements)
    out: list = [None] * len(runs)
    open_: list[int] = []

    def finish() -> None:
        words, linked = sum(runs[i].words for i in open_), sum(runs[i].words for i in open_ if runs[i].of >= 0 and elements[runs[i].of].linked)
        for i in open_:
            of = runs[i].of
            e = elements[of] if of >= 0 else None
            place = "#inside" if e and e.inner else "#outside" if whole else "" if e and e.plain else "#bare"
            out[i] = (of, _sized(words), _linked(linked, words), place, "#above" if above else "")
        open_.clear()

    for i, r in enumerate(runs):
        if r.text is not None:
            open_.append(i)
        elif r.block:
            finish()
            above = above and r.name != "h1"
    finish()
    return out


def insert_features(element: Element, words: list[int], linked: list[int], total: int, total_end: int, twins: int) -> list[str]:
    """What an element inside the region is judged by: its names, share of words and of links, place and children.

    words and linked: how many stand before each run; total_end: how many stand before the region's end.
    """
    w, k = words[element.stop] - words[element.start], linked[element.stop] - linked[element.start]
    kind = "#named" if any(x[0] == "." for x in element.names) else "#plain"
    rest = max(0, total_end - words[element.stop])
    most = max(element.kids.values(), default=0)
    # Readers' comments are boxes that are alike; what an article puts into boxes of its own has paragraphs.
    place = "#tail" if 20 * rest <= total else "#middle"
    shape = "#paragraphs" if element.kids.get("p", 0) > 1 else "#boxes" if most > 1 and not element.kids.get("p") and element.name not in LISTS and not ITEMS.intersection(element.kids) else "#items" if most > 1 else "#one"
    headed = "#headed" if any(element.kids.get(h) for h in ("h1", "h2", "h3", "h4")) else "#bare"
    shape = [place, shape, place + shape, f"{shape}{min(most, 8).bit_length()}", shape + headed, shape + _linked(k, w), shape + kind]
    return [*element.names, *filter(None, shape), f"{element.name}{kind}", _sized(w), _linked(k, w), f"{element.name}{_linked(k, w)}", "#most" if 3 * w >= total else "#part", "#twins" if twins > 2 else "#single"]


class Weights:
    """Scores of words by what is around them, of tags by their names, and of elements that may be inserts."""

    def __init__(self, word: dict[str, float], tag: dict[str, float], insert: dict[str, float]):
        self.word, self.tag, self.insert = word, tag, insert

    def scores(self, runs: list[Run], elements: list[Element]) -> list[float]:
        """Of each text, above 0 if it has words, and of each tag, below 0."""
        get = self.word.get
        around: list[float] = []
        for e in elements:  # a parent stands before its children
            around.append((around[e.parent] if e.parent >= 0 else get("", 0.0)) + sum(get(f, 0.0) for f in e.new))
        out = []
        for r, d in zip(runs, described(runs, elements), strict=True):
            if r.text is None:
                out.append(self.of_tag(r, elements))
            else:
                z = (around[d[0]] if d[0] >= 0 else get("", 0.0)) + sum(get(f, 0.0) for f in d[1:])
                # The cube of the chance that the text is one of the article.
                out.append(max(1e-6, (1 / (1 + math.exp(-max(-30.0, min(30.0, z))))) ** 3) * r.words)
        return out

    def of_tag(self, run: Run, elements: list[Element]) -> float:
        """Inside an article element little, so that an insert doesn't cut off what follows it."""
        return LEAST if run.of >= 0 and elements[run.of].inner else self.tag.get(run.name, self.tag[""])

    def is_insert(self, features: list[str]) -> bool:
        return self.insert.get("", 0.0) + sum(self.insert.get(f, 0.0) for f in features) > 0


def region(scores: list[float]) -> tuple[int, int]:
    """The contiguous range of greatest sum, empty if none is above 0; the first and longest of equal ones."""
    best, at, stop, total, start = 0.0, 0, 0, 0.0, 0
    for i, s in enumerate(scores):
        if total < 0:
            total, start = 0.0, i
        total += s
        if total > best or (total == best > 0 and start == at):
            best, at, stop = total, start, i + 1
    return at, stop


def candidates(runs: list[Run], elements: list[Element], at: int, stop: int) -> list[tuple[Element, list[str]]]:
    """The elements with words that begin in the region and may be inserts, outer ones first, with their features.

    The region ends with a word, so the end tags of what it ends with lie behind it.
    """
    words, linked = [0], [0]
    for r in runs:
        words.append(words[-1] + r.words)
        linked.append(linked[-1] + (r.words if r.of >= 0 and elements[r.of].linked else 0))
    total = words[stop] - words[at]
    twins: dict[tuple, int] = {}
    for e in elements:
        twins[e.parent, e.names] = twins.get((e.parent, e.names), 0) + 1
    may = lambda e: e.name in INSERTS or any(x[0] == "." for x in e.names) and e.name not in INNER
    return [(e, insert_features(e, words, linked, total, words[stop], twins[e.parent, e.names])) for e in elements if at <= e.start < stop and words[e.stop] > words[e.start] and may(e)]


def main_text(page: str | None, weights: Weights) -> str:
    """The blocks of the content region, joined by an empty line."""
    runs, elements = parsed(page or "")
    at, stop = region(weights.scores(runs, elements))
    blocks, open_ = [], []
    inserts = [(e.start, e.stop) for e, f in candidates(runs, elements, at, stop) if weights.is_insert(f)]
    nth, past = 0, 0  # inserts are in order of their starts
    for i in range(at, stop):
        while nth < len(inserts) and inserts[nth][0] <= i:
            past = max(past, inserts[nth][1])
            nth += 1
        r = runs[i]
        if r.text is None:
            if r.block:
                blocks.append("".join(open_))
                open_ = []
            elif r.name == "br":
                open_.append(" ")
        elif i >= past:
            open_.append(r.text)
    blocks.append("".join(open_))
    return "\n\n".join(filter(None, (" ".join(html.unescape(b).split()) for b in blocks)))


SYLLABLES = ("ka", "lo", "mi", "ter", "an", "ro", "vel", "si", "dun", "pe", "gra", "no")


def labelled_pages(n: int = 200, seed: int = 7) -> list[list[tuple[str, bool]]]:
    """Made pages as pieces of markup with whether they belong to the article. Half of all class names mean nothing."""
    rng = random.Random(seed)
    some = lambda a, b: " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(rng.randint(a, b)))
    linked = lambda k: "".join(f'<li><a href="/{i}">{some(1, 3)}</a></li>' for i in range(k))

    def named(*names: str) -> str:
        name = rng.choice(names) if rng.random() < 0.5 else "-".join("".join(rng.choices(SYLLABLES, k=4)) for _ in range(rng.randint(1, 2)))
        return f'{rng.choice(("class", "class", "id"))}="{name}"'

    of = lambda tags, names, inner: f"<{(e := rng.choice(tags))} {named(*names)}>{inner}</{e}>"
    menu = lambda: rng.choice((f"<nav><ul>{linked(rng.randint(2, 9))}</ul></nav>", of(("div", "nav"), ("menu", "navbar", "breadcrumbs", "pagination", "tags"), f"<ul>{linked(rng.randint(2, 7))}</ul>"), f"<ul>{linked(rng.randint(2, 7))}</ul>"))
    advert = lambda: of(("div", "div", "section"), ("ad", "advert", "banner", "sponsored", "promo"), rng.choice((f"<p>{some(2, 40)}</p>", some(2, 25), f"<a href='/x'>{some(2, 12)}</a>")))
    aside = lambda: rng.choice((f"<aside><h3>{some(1, 3)}</h3><p>{some(5, 40)}</p></aside>", of(("div", "aside"), ("sidebar", "widget", "related", "recommended"), f"<h3>{some(1, 4)}</h3><p>{some(4, 40)}</p>")))
    notice = lambda: of(("div",), ("cookie-notice", "notice", "consent", "newsletter", "popup", "alert"), f"<p>{some(5, 40)}</p>")
    form = lambda: f'<form action="/s"><p>{some(2, 20)}</p><label>{some(1, 4)}</label><input name="q"></form>'
    by = lambda: rng.choice(("", f"<b>{some(1, 2)}</b>", f"<span>{some(1, 2)}</span> <time>{some(1, 2)}</time>", f"<header>{some(1, 3)}</header>", f"<a href='/u'>{some(1, 2)}</a>"))

    def remarks(k: int) -> str:
        """Readers' comments of a page look alike."""
        e, name, head = rng.choice(("div", "li", "article")), rng.choice(("", f" {named('comment', 'reply')}")), by()
        return "".join(f"<{e}{name}>{re.sub('>[^<]+<', f'>{some(1, 2)}<', head)}<p>{some(3, 60)}</p></{e}>" for _ in range(k))

    comments = lambda: of(("section", "div"), ("comments", "replies", "discussion"), f"<h2>{some(1, 3)}</h2>" * rng.randint(0, 1) + remarks(rng.randint(1, 9)))
    header = lambda: rng.choice((f"<header><h1>{some(1, 4)}</h1><p>{some(2, 8)}</p></header>", of(("div",), ("header", "masthead"), some(2, 12))))
    footer = lambda: rng.choice((f"<footer>&copy; {some(2, 25)}</footer>", f"<footer>&copy; {some(2, 12)}<p>{some(2, 20)}</p></footer>", of(("div",), ("footer", "copyright"), some(2, 25))))
    before, after, within = (menu, header, advert, notice, form, aside), (aside, form, comments, comments, advert, menu, footer), (advert, advert, aside, form, notice, menu)
    body = (
        lambda: f"<p>{some(1, 90)}</p>",
        lambda: f"<p>{some(8, 90)}</p>",
        lambda: f"<p>{some(1, 2)}</p>",
        lambda: f"<p><b>{some(1, 30)}<br>",
        lambda: f"<p>{some(4, 20)} <em>{some(1, 3)}</em>, <a href='x'>{some(1, 3)}</a> {some(5, 30)}</p>",
        lambda: f"<{(e := rng.choice(('ul', 'ol')))}>{''.join(f'<li>{some(1, 9)}</li>' for _ in range(rng.randint(1, 6)))}</{e}>",
        lambda: f"<blockquote>{some(2, 30)}</blockquote>",
        lambda: f"<h2>{some(1, 5)}</h2>",
        lambda: f"<table><tr><td>{some(1, 4)}</td><td>{some(1, 4)}</td></tr></table>",
        lambda: f"<pre>{some(3, 20)}</pre>",
        lambda: f"<figure><img src=x><figcaption>{some(2, 12)}</figcaption></figure>",
        lambda: f"<p {named('lead', 'intro')}>{some(4, 40)}</p>",
        lambda: f"<section><h2>{some(1, 5)}</h2>{''.join(f'<p>{some(6, 60)}</p>' for _ in range(rng.randint(1, 4)))}</section>",
        lambda: of(("div", "section"), ("block", "row", "chapter", "part"), "".join(f"<p>{some(6, 60)}</p>" for _ in range(rng.randint(2, 5)))),
        lambda: f"<table><tbody>{''.join('<tr>' + ''.join(f'<td>{some(1, 3)}</td>' for _ in range(6)) + '</tr>' for _ in range(rng.randint(2, 6)))}</tbody></table>",
        lambda: f"<figure {named('figure', 'image', 'photo')}><img src=x><figcaption>{some(2, 12)} <span {named('credit', 'source')}>{some(1, 4)}</span></figcaption></figure>",
    )
    pages = []
    for k in range(n):
        pieces: list[tuple[str, bool]] = [("<html><head><title>x</title></head><body>", False)]
        pieces += [(rng.choice(before)(), False) for _ in range(rng.randint(1, 4))]
        outer = rng.choice(("article", "article", "main", f'div {named("content", "post entry", "story")}', 'div id="main"', "section", "div"))
        wraps = [outer, *([rng.choice((f"div {named('body', 'text')}", "div", "section"))] if rng.random() < 0.3 else [])]
        pieces += [(f"<{w}>", False) for w in wraps]
        pieces.append((rng.choice((f"<h1>{some(1, 8)}</h1>", f"<header><h1>{some(1, 8)}</h1></header>" if outer == "article" else f"<h1>{some(1, 8)}</h1>")), True))
        kinds = body[:2] if k % 3 == 0 else body
        for i in range(rng.randint(2, 16)):
            pieces.append((rng.choice(kinds)(), True))
            if i and rng.random() < 0.12:
                pieces.append((rng.choice(within)(), False))
        pieces.append((body[1](), True))
        pieces += [(rng.choice((comments, comments, aside, menu))(), False)] * (rng.random() < 0.45)
        pieces += [(f"</{w.split()[0]}>", False) for w in reversed(wraps)]
        pieces += [(rng.choice(after)(), False) for _ in range(rng.randint(0, 3))] + [(footer(), False)] * rng.randint(0, 1)
        pages.append([*pieces, ("</body></html>", False)])
    return pages


def _regression(examples: list[tuple[list[str], bool, float]], penalty: float, steps: int = 400) -> dict[str, float]:
    """Weights of a logistic regression over present features, "" the bias. examples: features, label, weight.

    Features of fewer than LEAST_EXAMPLES examples, such as names that are one page's, aren't learned.
    """
    counts = Counter(f for fs, _, _ in examples for f in set(fs))
    seen = {f: i for i, f in enumerate(sorted({f for f, n in counts.items() if n >= LEAST_EXAMPLES} | {""}))}
    x = np.zeros((len(examples), len(seen)))
    for row, (fs, _, _) in zip(x, examples, strict=True):
        row[[seen[f] for f in fs if f in seen] + [seen[""]]] = 1
    y, weight = np.array([e[1] for e in examples], float), np.array([e[2] for e in examples])
    weight = weight / weight.sum()
    w, g2 = np.zeros(len(seen)), np.full(len(seen), 1e-8)
    for _ in range(steps):
        g = x.T @ (weight * (1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) - y)) + penalty * w
        g2 += g * g
        w -= 0.5 * g / np.sqrt(g2)
    return {f: float(w[i]) for f, i in seen.items()}


@cache
def trained_weights(n: int = 400, seed: int = 7) -> Weights:
    """Weights from labelled pages. A text's label is that of the piece it stands in; an element is an insert if it begins a
    piece that is not the article's, between two that are. A tag costs the more, the less often it stands in articles."""
    texts: list[tuple[list[str], bool, float]] = []
    inserts: list[tuple[list[str], bool, float]] = []
    tags: dict[str, list[int]] = {}
    known = []
    for pieces in labelled_pages(n, seed):
        label, cut = [], []
        runs, elements = parsed("".join(p for p, _ in pieces))
        # Pieces end where tags or texts do, so the runs of the pieces are those of the page.
        for p, good in pieces:
            label += [good] * len(parsed(p)[0])
            cut.append(len(label))
        if len(label) != len(runs):
            raise AssertionError("a labelled page's pieces don't add up to the page")
        for r, d, good in zip(runs, described(runs, elements), label, strict=True):
            if r.text is None:
                if not (r.of >= 0 and elements[r.of].inner):
                    tags.setdefault(r.name, [0, 0])[good] += 1
            elif r.words:
                texts.append(([*features_around(d[0], elements), *filter(None, d[1:])], good, min(r.words, 20) ** 0.5))
        known.append((runs, elements, label, cut))
    cost = {name: LEAST - 0.25 * max(0.0, math.log((bad + 1) / (good + 1))) for name, (bad, good) in tags.items()} | {"": -0.05}
    word = _regression(texts, 3e-4)
    for runs, elements, label, cut in known:
        # Inserts are learned in the regions that the words and tags give.
        first, last = label.index(True), len(label) - label[::-1].index(True)
        at, stop = region(Weights(word, cost, {}).scores(runs, elements))
        at, stop = min(at, first), max(stop, last)
        begins = {0, *cut}
        inserts += [(f, not label[e.start], 1.0 if e.start in begins or label[e.start] else 0.3) for e, f in candidates(runs, elements, at, stop)]
        outer = [e for e in elements if e.start < first and e.stop >= last and e.name not in ("html", "body", *INNER)]
        inserts += [([*e.names, f"{e.name}{'#named' if len(e.names) > 1 else '#plain'}", "#words7", "#links0", f"{e.name}#links0", "#most", "#single", "#tail"], False, 1.0) for e in outer]
    return Weights(word, cost, _regression(inserts, INSERT_PENALTY))


def extracted(pages: DataFrame, weights: Weights | None = None, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """pages with the main text of each, in place of a column of that name."""
    ship(pages.sparkSession)
    found = weights or trained_weights()
    word, tag, insert = found.word, found.tag, found.insert

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w = Weights(word, tag, insert)
        for pages in batches:
            yield pd.Series([main_text(p, w) for p in pages], dtype="object")

    return pages.withColumn(text_col, text(F.col(html_col)))


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


SQL: dict[str, str] = {}
QUERIES = {"op7_html_extract": op7_html_extract}
