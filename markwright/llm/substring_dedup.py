"""Substring dedup over words: a compressed FM-index for each shard, backward search, matching statistics.

A word goes if a window of ``length`` consecutive words that covers it also starts anywhere else, in the same document
or another. Words are ``[^\\x20\\x09-\\x0D]+``, unchanged; windows are judged on the input.

Anchors (see ``anchors``) bring the passages that could be equal to one shard, each window start in one passage only.
A shard's passages form one text. Its FM-index is the Burrows-Wheeler transform in a wavelet tree over the shard's
word numbers (packed bit vectors with block ranks, one for each bit of a number) with the lengths of common prefixes.
Passages then stream through it backwards, all at once: the state of each is the interval of suffixes that start
with its current match; a step that leaves fewer than two occurrences first falls back to the parent interval. This
gives for each place the longest match that occurs at least twice; windows whose match is long enough are reported.

Results: null text has no words; texts with fewer words lose nothing. Rows with equal doc_id and text are one
document. Other columns pass through; those named like the results are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from markwright.llm import anchors
from markwright.llm.common import Scratch, as_bytes, hash_words, tidy

LENGTH = 35
GRAM = 10


class BitVector:
    """Packed bits; ``rank`` counts the ones before each of many places.

    Counts are kept for blocks of 512 bits (32 bits each), and from there for words of 64 (16 bits each).
    """

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 512) * 512, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        counts = np.bitwise_count(self.words).astype(np.int64)
        before = np.cumsum(counts) - counts
        self.ones = int(counts.sum())
        self.blocks = before[::8].astype(np.uint32)
        self.inside = (before - np.repeat(before[::8], 8)).astype(np.uint16)

    def rank(self, at: np.ndarray) -> np.ndarray:
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        ones = np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))
        return self.blocks[word >> 3].astype(np.int64) + self.inside[word] + ones


class WaveletTree:
    """A sequence of numbers, level by level from the highest bit; on each level zeros go before ones."""

    def __init__(self, values: np.ndarray, top: int):
        self.levels = []
        for b in range(max(1, int(top).bit_length()) - 1, -1, -1):
            bits = ((values >> b) & 1).astype(np.uint8)
            vector = BitVector(bits)
            self.levels.append((b, vector, len(values) - vector.ones))
            values = np.concatenate([values[bits == 0], values[bits == 1]])

    def rank(self, value: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each value occurs before its place."""
        low, high = np.zeros_like(at), at
        for b, vector, zeros in self.levels:
            one = ((value >> b) & 1).astype(bool)
            r_low, r_high = vector.rank(low), vector.rank(high)
            low = np.where(one, zeros + r_low, low - r_low)
            high = np.where(one, zeros + r_high, high - r_high)
        return high - low


def suffix_array(text: np.ndarray, most: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """By prefix doubling, to ``most`` symbols; the text's end marks differ from each other. Also the ranks by the first k."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int32)
    n, k = len(text), 1
    ranks = [(1, rank)]
    while True:
        key = rank.astype(np.int64) * (n + 1)
        key[: n - k] += rank[k:] + 1
        order = np.argsort(key, kind="stable")
        fresh = np.ones(n, np.int32)
        fresh[1:] = key[order[1:]] != key[order[:-1]]
        rank = np.empty(n, np.int32)
        rank[order] = np.cumsum(fresh, dtype=np.int32) - 1
        k *= 2
        ranks.append((k, rank))
        if k >= most or rank.max() == n - 1:
            return order, ranks


def _smaller_before(values: np.ndarray) -> np.ndarray:
    """For each place the nearest one before it with a smaller value (the first has none and points to itself)."""
    back = np.maximum(np.arange(len(values), dtype=np.int32) - 1, 0)
    live = np.arange(len(values))
    while True:
        live = live[(values[back[live]] >= values[live]) & (back[live] > 0)]
        if not len(live):
            return back
        back[live] = back[back[live]]


class FMIndex:
    """Over ``text`` (numbers up to ``top``; its end marks occur once each): the Burrows-Wheeler transform in a wavelet
    tree, and the intervals of common prefixes of neighbours.

    ``most`` is the longest match that counts (below 2**15): the passages are short, whatever the documents are.
    """

    def __init__(self, text: np.ndarray, most: int, top: int | None = None):
        n, top = len(text), int(text.max()) if top is None else top
        suffixes, ranks = suffix_array(text, most)
        self.place = np.empty(n, np.int32)
        self.place[suffixes] = np.arange(n, dtype=np.int32)
        self.tree = WaveletTree(text[suffixes - 1], top)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))]).astype(np.int64)
        self.size = n
        # common prefixes of neighbours, in steps of halved length
        a, b = suffixes[:-1].copy(), suffixes[1:].copy()
        common = np.zeros(n + 1, np.int16)
        for k, rank in reversed(ranks):
            same = (a < n) & (b < n)
            same[same] = rank[a[same]] == rank[b[same]]
            common[1:n] += (k * same).astype(np.int16)
            a += k * same
            b += k * same
        common[0] = common[n] = -1
        self.common = common
        self.left = _smaller_before(common)
        self.right = (n - _smaller_before(common[::-1])[::-1]).astype(np.int32)

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: the suffixes that start with the symbol, then with the interval's match."""
        base = self.first[symbol]
        return base + self.tree.rank(symbol, low), base + self.tree.rank(symbol, high)

    def parent(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.where(self.common[low] >= self.common[high], low, high)
        return self.left[at].astype(np.int64), self.right[at].astype(np.int64), np.maximum(self.common[at], 0).astype(np.int64)


def matching_statistics(index: FMIndex, text: np.ndarray, begins: np.ndarray, sizes: np.ndarray, least: np.ndarray | int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each place of the streamed passages the longest match from there on that the index holds ``least`` times (a
    number for each passage), and the interval of its suffixes."""
    out, lows, highs = np.zeros(len(text), np.int16), np.zeros(len(text), np.int32), np.zeros(len(text), np.int32)
    lane = np.flatnonzero(sizes > 0)
    least = np.broadcast_to(least, len(begins))
    at = (begins + sizes - 1)[lane]
    low, high, matched = np.zeros(len(lane), np.int64), np.full(len(lane), index.size, np.int64), np.zeros(len(lane), np.int64)
    while len(lane):
        a, b = index.step(text[at], low, high)
        good = b - a >= least[lane]
        stuck = ~good & (matched == 0)
        moved = good | stuck
        low, high, matched = np.where(good, a, low), np.where(good, b, high), matched + good
        back = np.flatnonzero(~moved)
        if len(back):
            low[back], high[back], matched[back] = index.parent(low[back], high[back])
            root = back[matched[back] == 0]
            low[root], high[root] = 0, index.size
        done = at[moved]
        out[done], lows[done], highs[done] = matched[moved], low[moved], high[moved]
        at = at - moved
        live = at >= begins[lane]
        lane, at, low, high, matched = lane[live], at[live], low[live], high[live], matched[live]
    return out, lows, highs


def repeated_windows(c: dict, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(context, start in it) of the windows that start elsewhere too.

    The index holds one context of each class. All contexts stream through it: a class's last member needs one
    occurrence, which is another document's; the others need two, as one is their own. Where a last member's interval
    holds its first member's suffix, the two windows are each other's.
    """
    n, first, sizes = len(c["sizes"]), c["first"], c["sizes"]
    _, words = np.unique(c["symbols"], return_inverse=True)
    words, held = words.ravel(), np.flatnonzero(first < 0)
    top = int(words.max()) + len(held)
    # the index's text: each passage ends in a mark of its own; marks come before all words
    own = sizes[held]
    where = np.cumsum(own + 1) - own - 1
    text, inside = np.empty(int(own.sum()) + len(held), np.int64), np.ones(int(own.sum()) + len(held), bool)
    inside[where + own] = False
    source = np.repeat(c["begins"][held] - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))
    text[inside], text[~inside] = words[source] + len(held), np.arange(len(held))
    index = FMIndex(text, int(sizes.max()) + 1, top)
    stats, low, high = matching_statistics(index, words + len(held), c["begins"], sizes, np.where(first < 0, 2, 1))
    starts = sizes - length + 1
    which = np.repeat(np.arange(n), starts)
    offset = np.arange(len(which)) - np.repeat(np.cumsum(starts) - starts, starts)
    at = c["begins"][which] + offset
    hit = stats[at] >= length
    begin = np.zeros(n, np.int64)
    begin[held] = where
    last = np.flatnonzero(hit & (first[which] >= 0))
    place = index.place[begin[first[which[last]]] + offset[last]]
    mutual = last[(low[at[last]] <= place) & (place < high[at[last]])]
    row = np.cumsum(starts) - starts  # where a context's windows begin among all
    hit[row[first[which[mutual]]] + offset[mutual]] = True
    return which[hit], offset[hit]


def _word_symbols():
    return lambda text: hash_words([text])[0]


def plan(length: int = LENGTH, gram: int = GRAM, **options: int) -> anchors.Plan:
    return anchors.Plan(length, gram, False, _word_symbols, repeated_windows, **options)


RESULT = "n_words long, n_removed long, kept_sha256 string, kept string"


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_text: bool = True, **options: int) -> DataFrame:
    """``docs`` with n_words, n_removed, kept_sha256 and, on request, kept (the words that stay, by one space).

    ``options``: ``buffer`` and ``flush`` of ``anchors.Plan``, which bound a task's memory and change no result.
    """
    new = [x.split()[0] for x in RESULT.split(", ")]
    named = docs.drop(*new)
    marked, spans_name = anchors.with_spans(named, plan(length, gram, **options), Scratch(docs.sparkSession, "substring"))
    names = named.columns if with_text else [c for c in named.columns if c != "text"]
    fields = StructType.fromDDL(RESULT).fields[: None if with_text else -1]
    at_text, at_spans = marked.columns.index("text"), marked.columns.index(spans_name)
    kept_at = [marked.columns.index(c) for c in names]

    def run(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            sizes, removed, digests, kept = [], [], [], []
            for text, marks in zip(as_bytes(batch.column(at_text)), batch.column(at_spans).to_pylist(), strict=True):
                words = (text or b"").split()
                sizes.append(len(words))
                left: list[bytes] = []
                at = 0
                for lo, hi in anchors.merge_spans(marks).tolist():
                    left += words[at:lo]
                    at = hi
                left += words[at:]
                joined = b" ".join(left)
                removed.append(len(words) - len(left))
                digests.append(hashlib.sha256(joined).hexdigest())
                kept.append(joined.decode() if with_text else None)
            columns = [pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())] + [pa.array(kept, pa.string())] * with_text
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in kept_at] + columns, names=names + [f.name for f in fields])

    return marked.mapInArrow(tidy(run), StructType(named.select(*names).schema.fields + fields))
