"""Longest matching blocks of two texts, by a suffix automaton, and the scores that stand on them.

The blocks are those that Python's own sequence matcher defines: the longest common run first, of equal ones that which
begins earliest in the first text, then in the second, and the same again on either side of it. In a second text of 200
characters or more, those that make up over one in a hundred (and one more) open no block, but blocks grow over them.
"""

from __future__ import annotations

import heapq
import itertools
from bisect import bisect_left
from collections import Counter
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


class SuffixAutomaton:
    """All runs of ``x[lo:hi]`` that hold none of ``dead``, in space linear in the text.

    A state stands for runs that end at the same places; ``first`` is the earliest of these, ``length`` the longest run,
    ``link`` the state of its longest suffix that ends at more places.
    """

    def __init__(self, x: str, lo: int, hi: int, dead: frozenset):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [-1]
        state = 0
        for at in range(lo, hi):
            state = 0 if x[at] in dead else self._grown(state, x[at], at)

    def _grown(self, state: int, c: str, at: int) -> int:
        """The state of the run of ``state`` with ``c`` after it, which ends at ``at``."""
        there = self.next[state].get(c)
        if there is not None:  # the run occurred before (only after a dead character)
            return there if self.length[there] == self.length[state] + 1 else self._split(state, c, there)
        new, p = self._state({}, -1, self.length[state] + 1, at), state
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def _state(self, step: dict, link: int, length: int, first: int) -> int:
        self.next.append(step)
        self.link.append(link)
        self.length.append(length)
        self.first.append(first)
        return len(self.link) - 1

    def _split(self, p: int, c: str, q: int) -> int:
        """A state of its own for those runs of ``q`` that continue ``p``."""
        short = self._state(dict(self.next[q]), self.link[q], self.length[p] + 1, self.first[q])
        self.link[q] = short
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = short
            p = self.link[p]
        return short

    def runs(self, x: str, lo: int, hi: int):
        """(end in x, length, earliest end here) of the longest known run that ends at each place."""
        steps, link, longest, first = self.next, self.link, self.length, self.first
        state, size = 0, 0
        for at in range(lo, hi):
            c = x[at]
            while state and c not in steps[state]:
                state = link[state]
                size = longest[state]
            to = steps[state].get(c)
            if to is None:
                continue
            state, size = to, size + 1
            yield at, size, first[state]


class Live(NamedTuple):
    """The places of a text that aren't dead, in order, and for each the end of its run of such places."""

    places: list[int]
    ends: list[int]


def live(a: str, dead: frozenset) -> Live:
    places = [at for at, c in enumerate(a) if c not in dead]
    ends, end = places[:], -1
    for k in range(len(places) - 1, -1, -1):
        if k + 1 == len(places) or places[k + 1] != places[k] + 1:
            end = places[k] + 1
        ends[k] = end
    return Live(places, ends)


def _found_block(a: str, b: str, alo: int, ahi: int, blo: int, bhi: int, alive: Live | None) -> tuple[int, int, int]:
    """The first longest run, by looking for ever longer ones: each place of ``a`` is asked for a run longer than the best."""
    part, i, j, size = b[blo:bhi], alo, blo, 0
    if alive is None:
        at = alo
        while at + size < ahi:
            if a[at : at + size + 1] in part:
                place, size = _grown(a, part, at, ahi, size + 1)
                i, j = at, blo + place
            at += 1
        return i, j, size
    places, ends = alive
    for k in range(bisect_left(places, alo), bisect_left(places, ahi)):
        at, end = places[k], min(ends[k], ahi)
        if at + size < end and a[at : at + size + 1] in part:
            place, size = _grown(a, part, at, end, size + 1)
            i, j = at, blo + place
    return i, j, size


def _grown(a: str, part: str, at: int, end: int, size: int) -> tuple[int, int]:
    """(first place in the part, size) of the longest run of ``a[at:end]``, of which so much is known to be there."""
    place = part.find(a[at : at + size])
    while at + size < end:
        if a[at + size] != part[place + size : place + size + 1]:
            later = part.find(a[at : at + size + 1], place)
            if later < 0:
                break
            place = later
        size += 1
    return place, size


def _automaton_block(a: str, b: str, alo: int, ahi: int, blo: int, bhi: int, dead: frozenset) -> tuple[int, int, int]:
    """The first longest run, by the automaton of the shorter side: in time linear in both."""
    i, j, size = alo, blo, 0
    if ahi - alo >= bhi - blo:
        for at, n, other in SuffixAutomaton(b, blo, bhi, dead).runs(a, alo, ahi):
            if n > size:
                i, j, size = at - n + 1, other - n + 1, n
    else:
        for at, n, other in SuffixAutomaton(a, alo, ahi, dead).runs(b, blo, bhi):
            if n > size or (n == size and other - n + 1 < i):
                i, j, size = other - n + 1, at - n + 1, n
    return i, j, size


#: fixed value: up to how many times both lengths their product may be for a search place by place; beyond it costs more
SEARCHED = 1000


def longest_block(a: str, b: str, alo: int, ahi: int, blo: int, bhi: int, dead: frozenset, alive: Live | None) -> tuple[int, int, int]:
    """(place in a, place in b, size) of the first longest block. ``alive``: ``live`` places of a, if anything is dead."""
    if (ahi - alo) * (bhi - blo) <= SEARCHED * (ahi - alo + bhi - blo):
        i, j, size = _found_block(a, b, alo, ahi, blo, bhi, alive)
    else:
        i, j, size = _automaton_block(a, b, alo, ahi, blo, bhi, dead)
    while i > alo and j > blo and a[i - 1] == b[j - 1]:
        i, j, size = i - 1, j - 1, size + 1
    while i + size < ahi and j + size < bhi and a[i + size] == b[j + size]:
        size += 1
    return i, j, size


#: fixed value: the length from which frequent characters of the second text open no block
POPULAR_FROM = 200


def popular(b: str) -> frozenset:
    #: fixed value: the share
    if len(b) < POPULAR_FROM:
        return frozenset()
    most = len(b) // 100 + 1
    return frozenset(c for c, n in Counter(b).items() if n > most)


def matching_blocks(a: str, b: str) -> list[tuple[int, int, int]]:
    """(place in a, place in b, size) of all blocks in order; neighbours stay apart."""
    dead, todo, out = popular(b), [(0, len(a), 0, len(b))], []
    alive = live(a, dead) if dead else None
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        i, j, size = longest_block(a, b, alo, ahi, blo, bhi, dead, alive)
        if size:
            out.append((i, j, size))
            if alo < i and blo < j:
                todo.append((alo, i, blo, j))
            if i + size < ahi and j + size < bhi:
                todo.append((i + size, ahi, j + size, bhi))
    return sorted(out)


def ratio(a: str, b: str) -> float:
    """Twice the characters in blocks as a share of all characters; 1 for two empty texts."""
    both = len(a) + len(b)
    return 2.0 * sum(n for *_, n in matching_blocks(a, b)) / both if both else 1.0


def sequence_score(a: str | None, b: str | None) -> float:
    """The ratio of two normalised texts; 1 if one holds the other, 0 if one is empty."""
    if not a or not b:
        return 0.0
    return 1.0 if a in b or b in a else ratio(a, b)


#: fixed values: up to how long a target's blocks are worked out by parts of windows, and how many parts are kept
BY_PARTS, MOST_PARTS = 400, 200_000


class Windows:
    """The ratios of one target with runs of a line's words. Windows that begin or end alike share what is known of them."""

    def __init__(self, target: list[str], words: list[str]):
        self.target, self.words, self.line = " ".join(target), words, " ".join(words)
        self.letters = sorted(set(self.target))
        self.begins = [0, *itertools.accumulate(len(w) + 1 for w in words)]  # of each word, and past the line
        self.places: dict[str, int] = {}
        for i, c in enumerate(self.target):
            self.places[c] = self.places.get(c, 0) | 1 << i
        self.common: dict[int, list[int]] = {}
        self.parts: dict[tuple[int, int, int, int], int] = {}

    def letter_bounds(self, sizes: range) -> list[tuple[float, int, int]]:
        """(bound, words, first word) of all windows: no ratio is above the share of characters that both have, in whatever order."""
        wanted = np.array([self.target.count(c) for c in self.letters])
        held = np.cumsum([[0] * len(self.letters)] + [[w.count(c) for c in self.letters] for w in self.words], axis=0)
        begins, blank, out = np.array(self.begins), np.array([c == " " for c in self.letters]), []
        for n in sizes:
            own = held[n:] - held[:-n] + blank * (n - 1)
            size = begins[n:] - begins[:-n] - 1
            out += [(bound, n, i) for i, bound in enumerate((2 * np.minimum(own, wanted).sum(1) / (size + len(self.target))).tolist())]
        return out

    def order_bound(self, n: int, i: int, most: int) -> float:
        """Nor is one above that of the longest common subsequence, of which blocks are a part: one addition of whole rows for
        each character, for all windows of up to ``most`` words that begin alike."""
        if i not in self.common:
            whole = (1 << len(self.target)) - 1
            row, places, found = whole, self.places, []
            for k, word in enumerate(self.words[i : i + most]):
                for c in " " + word if k else word:
                    hit = row & places.get(c, 0)
                    row = ((row + hit) | (row - hit)) & whole
                found.append(len(self.target) - row.bit_count())
            self.common[i] = found
        return 2 * self.common[i][n - 1] / (self.begins[i + n] - 1 - self.begins[i] + len(self.target))

    def ratio(self, n: int, i: int) -> float:
        lo, hi = self.begins[i], self.begins[i + n] - 1
        if hi - lo >= POPULAR_FROM or len(self.target) > BY_PARTS:
            return ratio(self.target, self.line[lo:hi])
        if len(self.parts) > MOST_PARTS:
            self.parts.clear()
        return 2.0 * self._matched(0, len(self.target), lo, hi) / (hi - lo + len(self.target))

    def _matched(self, alo: int, ahi: int, blo: int, bhi: int) -> int:
        """Characters in blocks of a part of the target and a part of the line, where nothing is dead."""
        part = (alo, ahi, blo, bhi)
        if part not in self.parts:
            i, j, size = _found_block(self.target, self.line, alo, ahi, blo, bhi, None)
            sum_ = size
            if size:
                if alo < i and blo < j:
                    sum_ += self._matched(alo, i, blo, j)
                if i + size < ahi and j + size < bhi:
                    sum_ += self._matched(i + size, ahi, j + size, bhi)
            self.parts[part] = sum_
        return self.parts[part]


def _best_window(target: list[str], words: list[str], sizes: range, least: float = 0.0) -> float:
    """The largest ratio of the target with any run of so many words, if it is above ``least``; else ``least``.

    The window of the highest bound is always the next to be looked at: its letters bound it first, then their order, then
    its ratio is worked out, until no bound is above the best ratio.
    """
    windows, best = Windows(target, words), least
    todo = [(-bound, 0, n, i) for bound, n, i in windows.letter_bounds(sizes) if bound > best]
    heapq.heapify(todo)
    while todo and -todo[0][0] > best:
        bound, known, n, i = todo[0]
        if known:
            heapq.heappop(todo)
            best = max(best, windows.ratio(n, i))
        else:
            heapq.heapreplace(todo, (max(bound, -windows.order_bound(n, i, sizes[-1])), 1, n, i))
    return best


def _line_parts(target: str, line: str, a: list[str], b: list[str]) -> tuple[float, float]:
    """(coverage, overlap) of the words of both."""
    both = len(set(a) & set(b))
    return both / len(set(a)), both / len(set(a) | set(b))


def _line_sum(coverage: float, local: float, overlap: float, whole: float) -> float:
    #: fixed values: the weights
    return min(1.0, 0.55 * coverage + 0.25 * local + 0.15 * overlap + 0.05 * whole + (0.10 if coverage >= 0.75 else 0.0))


def line_score(target: str | None, line: str | None, least: float = -1.0) -> float | None:
    """How well a short target is found in a line: its words, the window most like it, and both as a whole (normalised).
    None if that is certainly below ``least``."""
    a, b = (target or "").split(), (line or "").split()
    if not a or not b:
        return 0.0
    coverage, overlap = _line_parts(target, line, a, b)
    if _line_sum(coverage, 1.0, overlap, 1.0) < least:
        return None
    whole = ratio(target, line)
    #: fixed values: how much longer or shorter a window may be
    slack = 1 if len(a) <= 3 else max(2, int(len(a) * 0.35))
    sizes = range(max(1, len(a) - slack), min(len(b), len(a) + slack) + 1)
    enough = max(0.0, (least - _line_sum(coverage, 0.0, overlap, whole)) / 0.25 - 1e-9)  # a window below that doesn't help
    local = _best_window(a, b, sizes, enough) if enough < 1.0 else 1.0
    out = _line_sum(coverage, local, overlap, whole)
    return None if enough and local <= enough or out < least else out


#: fixed value: by how much scores may differ and still be equal to four places
SAME = 1.1e-4


def best_lines(target: str | None, lines: list[str]) -> list[tuple[int, float]]:
    """(line, score) of those lines that a target may be found in best, to four places; the others are certainly below.

    Lines with most of the target's words go first; what can't reach the best score so far isn't worked out.
    """
    a = (target or "").split()
    bounds = [_line_sum(*((parts := _line_parts(target, x, a, b))[0], 1.0, parts[1], 1.0)) if a and (b := (x or "").split()) else 0.0 for x in lines]
    best, out = -1.0, []
    for at in sorted(range(len(lines)), key=lambda k: (-bounds[k], k)):
        if bounds[at] < best - SAME:
            break
        score = line_score(target, lines[at], best - SAME)
        if score is not None:
            out.append((at, score))
            best = max(best, score)
    return out


def agreement(texts: list[str], i: int) -> float:
    """How like its peers one of several readings is: the mean ratio with those that hold anything, a half without any."""
    own = " ".join((texts[i] or "").lower().split())
    peers = [" ".join(t.lower().split()) for k, t in enumerate(texts) if k != i and t and t.strip()]
    return sum(ratio(own, t) for t in peers) / len(peers) if peers else 0.5


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def agreements(texts: pd.Series) -> pd.Series:
    return pd.Series([[agreement(list(own), i) for i in range(len(own))] for own in texts])


def _pairwise(score):
    @F.pandas_udf(T.DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([score(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return run


sequence_ratio = _pairwise(sequence_score)
plain_ratio = _pairwise(lambda x, y: ratio(x or "", y or ""))
line_match = _pairwise(line_score)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("line", T.IntegerType()), T.StructField("score", T.DoubleType())])))
def best_line_scores(target: pd.Series, lines: pd.Series) -> pd.Series:
    return pd.Series([[{"line": at, "score": score} for at, score in best_lines(x, list(own))] for x, own in zip(target, lines, strict=True)])
