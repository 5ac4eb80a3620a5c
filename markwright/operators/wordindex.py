"""Indexes over the words of a bank of items, that texts are streamed past: the best items of a text, and items in it."""

from __future__ import annotations

import re
from collections import deque

import numpy as np

from markwright.functions import text as tx

#: byte -> itself, in lower case, if it is a letter or digit of ASCII, else a blank
_PLAIN = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
_FOLDED = str.maketrans(tx.SUPERSCRIPTS + tx.SUBSCRIPTS + tx.SIGNS, tx.DIGITS + tx.DIGITS + tx.SIGNS_TO)
_FOLDS = re.compile("[" + re.escape(tx.SUPERSCRIPTS + tx.SUBSCRIPTS + tx.SIGNS) + "]")


def words_of(x: str | None) -> list[bytes]:
    """The words that ``text.tokens`` gives, in turn."""
    if not x:
        return []
    if not x.isascii():
        x = (x.translate(_FOLDED) if _FOLDS.search(x) else x).lower()
    return x.encode("utf-8", "replace").translate(_PLAIN).split()


FEW = 1 << 14  # postings of a text that are simply read


def rounded(score: np.ndarray) -> np.ndarray:
    return np.floor(score * 10_000 + 0.5) / 10_000


def overlap_score(shared: np.ndarray, n_q: int, n_r: np.ndarray) -> np.ndarray:
    return shared / max(1, n_q)


def jaccard_score(shared: np.ndarray, n_q: int, n_r: np.ndarray) -> np.ndarray:
    """In four places."""
    return rounded(shared / np.maximum(1, n_q + n_r - shared))


SCORES = {"overlap": overlap_score, "jaccard": jaccard_score}


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... for size[0] steps, then begin[1], ..."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())


class ItemIndex:
    """Items by word and words by item, for the best items of a text after the MaxScore rule.

    A text's words are taken rarest first. Once the words that are left could not lift an item that hasn't been met to
    the k-th best score so far, their lists - the long ones - stay closed: what has been met is scored by its own words.
    ``touched`` counts the postings and item words that were read.
    """

    def __init__(self, rows: list[tuple[int, list[bytes]]]):
        rows = [(i, sorted(set(own))) for i, own in sorted(rows, key=lambda r: r[0]) if own]
        self.ids = np.array([i for i, _ in rows], np.int64)
        self.numbers: dict[bytes, int] = {}
        own = [np.array([self.numbers.setdefault(w, len(self.numbers)) for w in words], np.int64) for _, words in rows]
        self.sizes = np.array([len(x) for x in own], np.int64)
        self.words = np.concatenate(own) if own else np.zeros(0, np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        order = np.argsort(self.words, kind="stable")
        self.items = np.repeat(np.arange(len(rows)), self.sizes)[order]
        self.lengths = np.bincount(self.words, minlength=len(self.numbers))
        self.lists = np.cumsum(self.lengths) - self.lengths
        self.count, self.held = np.zeros(len(rows), np.int64), np.zeros(len(self.numbers), bool)
        self.touched = 0

    def known(self, words: set[bytes]) -> np.ndarray:
        """Numbers of the words that some item holds, rarest first."""
        found = [n for n in map(self.numbers.get, words) if n is not None]
        found = np.array(found, np.int64)
        return found[np.argsort(self.lengths[found], kind="stable")]

    def _meet(self, words: np.ndarray) -> np.ndarray:
        """Counts the words for all items of their lists, and returns those."""
        postings = self.items[_ranges(self.lists[words], self.lengths[words])]
        self.touched += len(postings)
        met, many = np.unique(postings, return_counts=True)
        self.count[met] += many
        return met

    def _all(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every item that holds some of the words, and how many."""
        postings = np.concatenate([self.items[self.lists[w] : self.lists[w] + self.lengths[w]] for w in words.tolist()]) if len(words) else self.items[:0]
        self.touched += len(postings)
        count = np.bincount(postings, minlength=len(self.ids))
        met = np.flatnonzero(count)
        return met, count[met]

    def _shared(self, at: np.ndarray, known: np.ndarray) -> np.ndarray:
        """How many of the known words each of these items holds, by the items' own words."""
        self.held[known] = True
        flat = self.held[self.words[_ranges(self.begins[at], self.sizes[at])]]
        self.held[known] = False
        self.touched += len(flat)
        return np.add.reduceat(flat.astype(np.int64), np.cumsum(self.sizes[at]) - self.sizes[at]) if len(at) else np.zeros(0, np.int64)

    def best(self, words: set[bytes], k: int, by: str, larger_id: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(item, shared) of the k best; ties to the smaller or larger id."""
        known, score, n_q = self.known(words), SCORES[by], len(words)
        if self.lengths[known].sum() <= FEW and len(self.ids) <= FEW:  # not worth a second look
            met, shared = self._all(known)
            order = np.lexsort((-met if larger_id else met, -score(shared, n_q, self.sizes[met])))[:k]
            return met[order], shared[order]
        met, done, kth, ends = np.zeros(0, np.int64), 0, -1.0, np.cumsum(self.lengths[known])
        while done < len(known):
            left = np.array([len(known) - done])
            if score(left, n_q, left)[0] < kth:  # an item has as many words as it shares, at least
                break
            upto = max(done + 1, int(np.searchsorted(ends, 2 * ends[done - 1] + 64 if done else 64)))  # twice what was read so far
            met = np.union1d(met, self._meet(known[done:upto]))
            done = min(len(known), upto)
            if len(met) >= k:
                kth = np.partition(score(self.count[met], n_q, self.sizes[met]), len(met) - k)[len(met) - k]
        shared = self.count[met]
        self.count[met] = 0
        if done < len(known):
            most = np.minimum(shared + len(known) - done, self.sizes[met])
            met = met[score(most, n_q, self.sizes[met]) >= kth]
            shared = self._shared(met, known)
        order = np.lexsort((-met if larger_id else met, -score(shared, n_q, self.sizes[met])))[:k]
        return met[order], shared[order]

    def reaching(self, words: set[bytes], least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, shared) of all items whose Jaccard index may be at ``least[item]`` or above, rounded as it is."""
        known, n_q = self.known(words), len(words)
        low = np.maximum(least - 0.00005, 0)
        need = np.maximum(1, np.ceil(low / (1 + low) * (n_q + self.sizes) - 1e-6)).astype(np.int64)
        open_ = need <= np.minimum(self.sizes, len(known))
        if not open_.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if self.lengths[known].sum() <= FEW and len(self.ids) <= FEW:
            met, shared = self._all(known)
            some = shared >= need[met]
            return met[some], shared[some]
        done = len(known) - int(need[open_].min()) + 1  # an item without any of these rarest words has too few
        met = self._meet(known[:done])
        shared = self.count[met]
        self.count[met] = 0
        some = open_[met] & (shared + len(known) - done >= need[met])
        met, shared = met[some], shared[some]
        if done < len(known):
            shared = self._shared(met, known)
        some = shared >= need[met]
        return met[some], shared[some]


class WordAutomaton:
    """Items as sequences of words in one automaton after Aho and Corasick: one pass over a text finds all it holds.

    State 0 is the start. ``steps`` has the next state by (state, word), ``back`` the state of the longest proper suffix
    that is some item's beginning, ``ends`` the items that are complete in a state, shorter ones included.
    """

    def __init__(self, rows: list[tuple[int, list[bytes]]]):
        self.numbers: dict[bytes, int] = {}
        self.steps: dict[tuple[int, int], int] = {}
        self.back, self.ends = [0], [()]
        for item, words in rows:
            state = 0
            for w in words:
                key = (state, self.numbers.setdefault(w, len(self.numbers)))
                state = self.steps.get(key, -1)
                if state < 0:
                    state = self.steps[key] = len(self.back)
                    self.back.append(0)
                    self.ends.append(())
            if state:
                self.ends[state] += (item,)
        below: dict[int, list[tuple[int, int]]] = {}
        for (state, word), to in self.steps.items():
            below.setdefault(state, []).append((word, to))
        todo = deque(to for _, to in below.get(0, ()))
        while todo:  # level by level, so that shorter suffixes are complete
            state = todo.popleft()
            for word, to in below.get(state, ()):
                at = self.back[state]
                while at and (at, word) not in self.steps:
                    at = self.back[at]
                self.back[to] = self.steps.get((at, word), 0)
                self.ends[to] += self.ends[self.back[to]]
                todo.append(to)
        self.opens = np.zeros(len(self.numbers) + 1, bool)
        self.opens[[word for word, _ in below.get(0, ())]] = True

    def items_in(self, words: list[bytes]) -> set[int]:
        get, n = self.numbers.get, len(self.numbers)
        text = [get(w, n) for w in words]
        starts = np.flatnonzero(self.opens[text]) if text else ()  # elsewhere the start state stays
        found: set[int] = set()
        past, steps, back, ends = 0, self.steps, self.back, self.ends
        for start in starts:
            if start < past:
                continue
            state, past = 0, int(start)
            while past < len(text):
                word = text[past]
                while state and (state, word) not in steps:
                    state = back[state]
                state = steps.get((state, word), 0)
                past += 1
                if not state:
                    break
                if ends[state]:
                    found.update(ends[state])
        return found
