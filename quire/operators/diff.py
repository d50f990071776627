"""Text against text: tokens and characters of a page and of its reference text layer."""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from difflib import Match, SequenceMatcher
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import squashed
from quire.shipping import ship

#: Fixed value: a token: a word with inner dots, hyphens and the like.
TOKEN = r"[A-Za-z0-9_][A-Za-z0-9_.\-$#]*"
#: Fixed value: a real tag; arrows and comparisons in listings are none.
TAG = r"</?[a-zA-Z][a-zA-Z0-9]*(\s[^<>]*)?/?>"
#: Markup and math words that say nothing about the text.
NOISE = ["nbsp", "text", "textsf", "texttt", "mathrm", "mathbb", "begin", "end", "array", "quad", "qquad", "boxed", "ldots", "cdots", "prime", "left", "right", "setminus", "backslash", "rightarrow", "leftarrow", "overline", "sup", "div", "span", "table", "img", "src", "style", "border"]


def tokens(text: Column) -> Column:
    """Lower-case tokens of at least three characters, without punctuation at the ends."""
    raw = F.regexp_extract_all(F.lower(F.regexp_replace(text, TAG, " ")), F.lit(TOKEN), F.lit(0))
    return F.filter(F.transform(raw, lambda t: F.regexp_replace(t, r"^[._\-$#]+|[._\-$#]+$", "")), lambda t: F.length(t) >= 3)


def token_counts(texts: DataFrame, key: str) -> DataFrame:
    """(token, n, first) of texts (key, text): how often, and the least key that has it."""
    t = texts.select(key, F.explode(tokens(F.col("text"))).alias("token"))
    return t.groupBy("token").agg(F.count("*").alias("n"), F.min(key).alias("first"))


def missing_tokens(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Token counts of left without those that right has anywhere: an anti join of distinct tokens."""
    return token_counts(left, left_key).where(~F.col("token").isin(NOISE)).join(token_counts(right, right_key).select("token"), "token", "left_anti")


def written_differently(tokens: DataFrame, pages: DataFrame) -> DataFrame:
    """Tokens (page_no, token) that are part of the squashed text of that page (page_no, text), each once.

    A page's tokens come to it as one set, so its text is squashed once, whatever their number.
    """
    sets = tokens.groupBy("page_no").agg(F.collect_set("token").alias("tokens"))
    flat = pages.join(sets, "page_no").withColumn("flat", squashed(F.col("text")))
    return flat.select("page_no", F.explode(F.filter("tokens", lambda t: F.contains(F.col("flat"), t))).alias("token"))


def drop_furniture(text: Column) -> Column:
    """Without the first and the last line that aren't blank, if there are at least three of these."""
    ls = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    full = F.filter(ls, lambda s: F.trim(s["x"]) != "")
    first, last = F.element_at(full, 1)["i"], F.element_at(full, -1)["i"]
    kept = F.transform(F.slice(ls, first + 2, F.greatest(last - first - 1, F.lit(0))), lambda s: s["x"])
    return F.when(F.size(full) < 3, text).otherwise(F.array_join(kept, "\n"))


#: Quotes, dashes, ligatures and blanks of text layers.
SAME = {"\u2018": "'", "\u2019": "'", "\u201c": '"', "\u201d": '"', "\u2013": "-", "\u2014": "-", "\u2212": "-", "\u00ad": "", "\u00a0": "", "\ufb01": "fi", "\ufb02": "fl", "\u2026": "..."}
#: Common runs up to this length are found by sets of substrings, longer ones by an automaton.
SHORT = 64


class Folds(dict):
    """What a character is compared as, for str.translate: compatible forms, quotes, dashes and case are one, blanks are nothing.

    Filled when a character is met first.
    """

    def __missing__(self, code: int) -> str:
        folded = unicodedata.normalize("NFKC", SAME.get(chr(code), chr(code))).lower()
        self[code] = found = "".join(folded.split())
        return found


FOLDS = Folds()


def each(text: str, f: Callable[[str], int]) -> np.ndarray:
    """f of each character, called once for each different one."""
    codes, where = np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4"), return_inverse=True)
    return np.array([f(chr(c)) for c in codes.tolist()], "int64")[where]


class Layer:
    """A text as it is compared: without tags, references, white space and case. Its plain characters are found by offsets.

    Both sides of a comparison are folded, since white space, quotes and dashes differ between layers everywhere.
    """

    def __init__(self, text: str):
        self.plain = html.unescape(re.sub("<[^>]+>", " ", text))
        self.folded = self.plain.translate(FOLDS)

    @cached_property
    def ends(self) -> np.ndarray:
        """For each plain character, where its folded form ends."""
        return np.cumsum(each(self.plain, lambda c: len(FOLDS[ord(c)])))

    def at(self, place: int) -> int:
        """The plain character that the folded one at this place came from."""
        return int(np.searchsorted(self.ends, place, side="right"))

    def shown(self, start: int, stop: int, width: int | None = 120, before: int = 0) -> str:
        """The plain text of a folded range, with so many plain characters before it, blanks as one space, cut to a width."""
        first = max(0, self.at(start) - before)
        return " ".join(self.plain[first : self.at(stop - 1) + 1].split())[:width]


def _automaton(a: str, b: str) -> tuple[int, int, int]:
    """longest_common by b's suffix automaton, in time that grows with the lengths only."""
    nexts, link, size, first, last = [{}], [-1], [0], [0], 0
    for j, c in enumerate(b):
        cur, p = len(size), last
        nexts.append({})
        size.append(j + 1)
        first.append(j)
        link.append(0)
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            if size[q] == size[p] + 1:
                link[cur] = q
            else:
                clone = len(size)
                nexts.append(nexts[q].copy())
                size.append(size[p] + 1)
                first.append(first[q])
                link.append(link[q])
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    best, state, n = (0, 0, 0), 0, 0
    for i, c in enumerate(a):
        while state and c not in nexts[state]:
            state = link[state]
            n = size[state]
        if c in nexts[state]:
            state, n = nexts[state][c], n + 1
        if n > best[2]:
            best = (i + 1 - n, first[state] + 1 - n, n)
    return best


def longest_common(a: str, b: str) -> tuple[int, int, int]:
    """(i, j, n): the longest run a[i:i+n] == b[j:j+n], the first in a, then the first in b; n is 0 if there is none."""

    def parts(text: str, k: int):
        return (text[i : i + k] for i in range(len(text) - k + 1))

    def common(k: int) -> bool:
        return k <= len(a) and k <= len(b) and not set(parts(b, k)).isdisjoint(parts(a, k))

    if not common(1):
        return 0, 0, 0
    low = 1
    while common(2 * low):
        low *= 2
        if low == SHORT:
            return _automaton(a, b)
    high = 2 * low
    while high - low > 1:
        k = (low + high) // 2
        low, high = (k, high) if common(k) else (low, k)
    of_b = set(parts(b, low))
    i = next(i for i, x in enumerate(parts(a, low)) if x in of_b)
    return i, b.index(a[i : i + low]), low


class Matcher(SequenceMatcher):
    """difflib's matcher with the same results on strings, whose search doesn't grow with the product of the lengths."""

    def __init__(self, a: str, b: str):
        super().__init__(None, a, b, autojunk=False)

    def find_longest_match(self, alo=0, ahi=None, blo=0, bhi=None) -> Match:
        ahi, bhi = len(self.a) if ahi is None else ahi, len(self.b) if bhi is None else bhi
        i, j, n = longest_common(self.a[alo:ahi], self.b[blo:bhi])
        return Match(alo + i, blo + j, n)


#: Ranges are searched as strings if their lengths' product isn't above this, a search counting as that of so many characters.
SMALL, SEARCH = 40_000, 150
#: A run counts as present on the other side if so much of it is found there, in order.
PRESENT = 0.8


class Pair:
    """Two texts as one array, and the longest runs that ranges of them have in common, as difflib finds them.

    Runs of a length are numbered over both texts, by the numbers of two shorter ones; where a text has a run is looked up in
    its sorted (number, place). A search takes time by the shorter range only, and what is numbered serves all ranges.
    """

    def __init__(self, a: str, b: str):
        self.text, self.size, self.at = a + b, len(a) + len(b), len(a)
        chars = np.frombuffer((a + b).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        self.numbers = {1: np.unique(chars, return_inverse=True)[1].astype("int64")}
        self.sorted: dict[tuple[int, bool], np.ndarray] = {}
        self.shared: dict[int, np.ndarray] = {}

    def runs(self, k: int) -> np.ndarray:
        """The number of the run of length k at each place; -1 where a shorter run shows that the other text can't have it."""
        if k not in self.numbers:
            half = 1 << ((k - 1).bit_length() - 1)
            of, both = self.runs(half), self.both(half)
            many = self.size - k + 1
            at = np.flatnonzero(both[:many] & both[k - half : k - half + many])
            self.numbers[k] = np.full(many, -1, "int64")
            self.numbers[k][at] = np.unique(of[at] * self.size + of[at + k - half], return_inverse=True)[1]
        return self.numbers[k]

    def both(self, k: int) -> np.ndarray:
        """For each place, whether the other text has its run of length k anywhere."""
        if k not in self.shared:
            runs = self.runs(k)
            left, right = (np.zeros(self.size + 1, bool) for _ in range(2))
            left[runs[: max(self.at - k + 1, 0)]] = right[runs[self.at :]] = True
            left[-1] = right[-1] = False
            self.shared[k] = np.concatenate([right[runs[: self.at]], left[runs[self.at :]]])
        return self.shared[k]

    def places(self, k: int, right: bool) -> np.ndarray:
        """number * size + place of the runs of one text that the other has too, sorted."""
        if (k, right) not in self.sorted:
            start, stop = (self.at, self.size - k + 1) if right else (0, self.at - k + 1)
            at = start + np.flatnonzero(self.both(k)[start:stop])
            self.sorted[k, right] = np.sort(self.runs(k)[at] * self.size + at)
        return self.sorted[k, right]

    def common(self, k: int, lo: int, hi: int, start: int, stop: int) -> tuple[int, int, int] | None:
        """The first run of length k of lo:hi that the other text has in start:stop, and its first place there."""
        if k > hi - lo or k > stop - start:
            return None
        at = lo + np.flatnonzero(self.both(k)[lo : hi - k + 1])
        if not len(at):
            return None
        number = self.runs(k)[at] * self.size
        places = self.places(k, start >= self.at and lo < self.at)
        nth = np.searchsorted(places, number + start)
        found = places[np.minimum(nth, len(places) - 1)]
        here = (found >= number + start) & (found <= number + (stop - k))
        i = int(here.argmax())
        return (int(at[i]), int(found[i] - number[i]), k) if here[i] else None

    def longest(self, lo: int, hi: int, start: int, stop: int, most: int) -> tuple[int, int, int] | None:
        """(place, place in the other text, length) of the longest run that both ranges have; it isn't longer than most."""
        if (hi - lo) * (stop - start + SEARCH) <= SMALL:
            return self.longest_of_few(lo, hi, start, stop, min(hi - lo, stop - start, most))
        best, low, high = None, 0, min(hi - lo, stop - start, most) + 1
        k = min(4, high - 1)
        while high - low > 1:
            found = self.common(k, lo, hi, start, stop)
            best, low, high = (found, k, high) if found else (best, low, k)
            k = 2 * low if low and 2 * low < high else (low + high) // 2
        return best

    def longest_of_few(self, lo: int, hi: int, start: int, stop: int, most: int) -> tuple[int, int, int] | None:
        """longest by searching the other range for the runs of this one, each longer than the longest before."""
        text, find, best, n = self.text, self.text.find, None, 0
        while n < most and lo + n < hi:
            if (j := find(text[lo : lo + n + 1], start, stop)) >= 0:
                n += 1
                best = (lo, j, n)
            else:
                lo += 1
        return best

    def gaps(self, worth: Callable[[int, int], bool]) -> Iterator[tuple[int, int, int, int]]:
        """(lo, hi, start, stop), in order: what lies between the blocks that the texts have in common. Ranges of which neither
        side is worth it aren't looked into: a gap lies within one range, to the end."""
        todo = [(0, self.at, self.at, self.size, self.size)]
        while todo:
            lo, hi, start, stop, most = todo.pop()
            if worth(lo, hi) or worth(start, stop):
                if found := self.longest(lo, hi, start, stop, most):
                    i, j, n = found
                    todo += [(i + n, hi, j + n, stop, n), (lo, i, start, j, n)]
                else:
                    yield lo, hi, start, stop

    def is_found(self, lo: int, hi: int) -> bool:
        """Whether PRESENT of a run is found in the other text, in common blocks, in order; decided as soon as it is clear.

        In a range no more can be found than the shorter side has.
        """
        other = (0, self.at) if lo >= self.at else (self.at, self.size)
        todo, found, size = [(lo, hi, *other, hi - lo)], 0, hi - lo
        possible = min(size, other[1] - other[0])
        while todo and found / size < PRESENT <= possible / size:
            a, b, start, stop, most = todo.pop()
            possible -= min(b - a, stop - start)
            if block := self.longest(a, b, start, stop, most):
                i, j, n = block
                found += n
                possible += n
                for part in ((i + n, b, j + n, stop, n), (a, i, start, j, n)):
                    if room := min(part[1] - part[0], part[3] - part[2]):
                        todo.append(part)
                        possible += room
        return found / size >= PRESENT


def page_diffs(left: str, right: str, least: int = 30) -> list[tuple[str, int, str]]:
    """(direction, letters, snippet) of runs of at least least letters or digits that one side has and the other lacks.

    Texts are compared whole and normalised; a snippet is the beginning of the run as its text has it.
    """
    sides = Layer(left), Layer(right)
    a, b = (s.folded for s in sides)
    letters = np.concatenate([[0], np.cumsum(each(a + b, str.isalnum))])
    count = lambda lo, hi: int(letters[hi] - letters[lo])
    if a == b or max(count(0, len(a)), count(len(a), len(a) + len(b))) < least:
        return []
    pair, rows = Pair(a, b), []
    chars = [Counter(s) for s in (a, b)]

    def missing(lo: int, hi: int, other: Counter) -> bool:
        # The characters that both have, in any order, bound what is found; most runs that are really missing fail there.
        run = b[lo - len(a) : hi - len(a)] if lo >= len(a) else a[lo:hi]
        return (Counter(run) & other).total() / (hi - lo) < PRESENT or not pair.is_found(lo, hi)

    for lo, hi, start, stop in pair.gaps(lambda lo, hi: count(lo, hi) >= least):
        for direction, side, other, x, y in (("left_only", sides[0], chars[1], lo, hi), ("right_only", sides[1], chars[0], start, stop)):
            if count(x, y) >= least and missing(x, y, other):
                off = 0 if side is sides[0] else len(a)
                rows.append((direction, count(x, y), side.shown(x - off, y - off)))
    return rows


def layer_diff(pairs: DataFrame, least: int = 30) -> DataFrame:
    """(page_no, direction, letters, snippet) of pairs (page_no, left, right) of whole texts, which are normalised here.

    Equal pairs are sorted out before the Python function.
    """
    ship(pairs.sparkSession)
    few = pairs.where("left <> right")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, *r) for p, x, y in zip(b["page_no"], b["left"], b["right"], strict=True) for r in page_diffs(x, y, least)]
            yield pd.DataFrame(rows, columns=["page_no", "direction", "letters", "snippet"])

    return few.select("page_no", "left", "right").mapInPandas(run, "page_no bigint, direction string, letters int, snippet string")
