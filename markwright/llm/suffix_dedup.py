"""Suffix-array dedup of repeated byte strings, by deep-shallow sorting.

A byte goes if a string of ``length`` bytes that covers it also starts earlier: in a document with a smaller doc_id,
or earlier in the same one. Matches never cross documents and are judged on the input.

Anchors (see ``anchors``) bring the places that could be equal to one shard. There the sampled suffixes, those that
start at an anchor, are sorted, and so are the texts before the anchors read backwards. Sorting is deep-shallow: a
multikey quicksort over 8-byte characters to a shallow depth, then a blind trie for each group whose members still
agree, as groups with long common prefixes are what a corpus with copies has. The tries also yield the lengths of the
common prefixes. A window that starts ``l`` bytes before its anchor recurs where the suffixes agree for
``length - l`` bytes and the reversed texts for ``l``; the first of its class stays, the others are marked.

Results: null text counts as empty (0 bytes, nothing removed); texts below ``length`` bytes lose nothing. Rows with
equal doc_id and text are one document. Other columns pass through; those named like the results are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from markwright.llm import anchors
from markwright.llm.common import Scratch, as_bytes, mix64, tidy

LENGTH = 100
GRAM = 32
SHALLOW = 4  # characters of 8 bytes
#: 64-bit hash of each byte value
SYMBOLS = mix64(np.arange(1, 257, dtype=np.uint64))


def shallow_sort(words: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of rows of 64-bit characters within groups: the order, and where a row differs from the one
    before.

    A segment splits into the rows whose character is below, at, or above its pivot (the median of three rows); the
    middle part goes on to the next character. All segments of a round split at once.
    """
    n, depth = words.shape
    order, opens = np.argsort(group, kind="stable"), np.ones(n, bool)
    opens[1:] = group[order[1:]] != group[order[:-1]]
    low = np.flatnonzero(opens)
    high, at = np.append(low[1:], n), np.zeros(len(low), np.int64)
    while True:
        many = (high - low > 1) & (at < depth)
        low, high, at = low[many], high[many], at[many]
        if not len(low):
            return order, opens
        size = high - low
        segment = np.repeat(np.arange(len(low)), size)
        place = low[segment] + np.arange(len(segment)) - (np.cumsum(size) - size)[segment]
        rows = order[place]
        character = words[rows, at[segment]]
        three = np.stack([words[order[k], at] for k in (low, (low + high) // 2, high - 1)])
        pivot = np.sort(three, axis=0)[1][segment]
        side = 3 * segment + 1 + (character > pivot) - (character < pivot)
        order[place] = rows[np.argsort(side, kind="stable")]
        count = np.bincount(side, minlength=3 * len(low)).reshape(-1, 3)
        end = low[:, None] + np.cumsum(count, axis=1)
        begin = end - count
        opens[begin[count > 0]] = True
        low, high, at = begin.ravel(), end.ravel(), (at[:, None] + np.array([0, 1, 0])).ravel()


class BlindTrie:
    """A trie that stores branching depths and branch bytes only. Inserting descends without comparing, then compares
    with the one string that it reaches, and branches where they differ."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.depth: list[int] = []  # of inner nodes
        self.children: list[dict[int, int]] = []  # branch byte (-1: the end) -> inner node, or ~place of a leaf
        self.equal: dict[int, list[int]] = {}
        self.root = ~0
        for i in range(1, len(strings)):
            self._insert(i)

    def _insert(self, i: int) -> None:
        s, depth, children, node = self.strings[i], self.depth, self.children, self.root
        while node >= 0:
            at, below = depth[node], children[node]
            node = below.get(s[at] if at < len(s) else -1)
            if node is None:
                node = next(iter(below.values()))
        t = self.strings[~node]
        common = _common(s, t)
        if common == len(s) == len(t):
            self.equal.setdefault(~node, []).append(i)
            return
        parent, node = -1, self.root
        while node >= 0 and depth[node] < common:
            parent = node
            at = depth[node]
            node = children[node][s[at] if at < len(s) else -1]
        own = s[common] if common < len(s) else -1
        if node >= 0 and depth[node] == common:
            children[node][own] = ~i
            return
        depth.append(common)
        children.append({(t[common] if common < len(t) else -1): node, own: ~i})
        if parent < 0:
            self.root = len(depth) - 1
        else:
            at = depth[parent]
            children[parent][s[at] if at < len(s) else -1] = len(depth) - 1

    def walk(self) -> tuple[list[int], list[int]]:
        """The strings' places in sorted order, and the common prefix of each with the one before (0 for the first)."""
        order, common, shared = [], [], 0
        stack: list[tuple[int, int]] = [(self.root, 0)]
        while stack:
            node, shared = stack.pop()
            if node < 0:
                first = ~node
                order.append(first)
                common.append(shared)
                for i in self.equal.get(first, ()):
                    order.append(i)
                    common.append(len(self.strings[i]))
                continue
            below = sorted(self.children[node].items(), reverse=True)
            for k, (_, child) in enumerate(below):
                stack.append((child, shared if k == len(below) - 1 else self.depth[node]))
        return order, common


def _common(s: bytes, t: bytes) -> int:
    n = min(len(s), len(t))
    if s[:n] == t[:n]:
        return n
    x = int.from_bytes(s[:n]) ^ int.from_bytes(t[:n])
    return n - (x.bit_length() + 7) // 8


def deep_shallow(strings: list[bytes], group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorts within groups. The order, and each string's common prefix with the one before (-1 opens a group)."""
    n = len(strings)
    width = 8 * SHALLOW
    raw = np.frombuffer(b"".join(s[:width].ljust(width, b"\0") for s in strings), dtype=">u8").reshape(n, SHALLOW).astype(np.uint64)
    order, opens = shallow_sort(raw, group)
    common = np.zeros(n, np.int64)
    edges = np.append(np.flatnonzero(opens), n)
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if hi - lo > 1:
            places = order[lo:hi]
            walked, shared = BlindTrie([strings[i] for i in places.tolist()]).walk()
            order[lo:hi] = places[walked]
            common[lo:hi] = shared
    heads = edges[:-1]
    for at in heads[1:].tolist():
        if group[order[at]] == group[order[at - 1]]:
            common[at] = _common(strings[order[at - 1]], strings[order[at]])
        else:
            common[at] = -1
    if n:
        common[0] = -1
    return order, common


def repeated_windows(c: dict, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(context, start in it) of the windows that also start earlier. Contexts come in the order of the documents."""
    raw = _BYTE_OF[np.searchsorted(_SORTED, c["symbols"])].tobytes()
    begins, sizes, back, front = c["begins"], c["sizes"], c["back"], c["front"]
    _, group = np.unique(c["h"], return_inverse=True)
    right = [raw[b + k : b + n] for b, k, n in zip(begins.tolist(), back.tolist(), sizes.tolist(), strict=True)]
    left = [raw[b : b + k][::-1] for b, k in zip(begins.tolist(), back.tolist(), strict=True)]
    ranks, commons = [], []
    for strings in (right, left):
        order, common = deep_shallow(strings, group)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        ranks.append(rank)
        commons.append(common)
    which, offset = [], []
    for l in range(int(front.min()), int(back.max()) + 1):  # noqa: E741
        chosen = np.flatnonzero((front <= l) & (l <= back))
        ahead = np.cumsum(commons[0] < length - l)[ranks[0][chosen]]
        behind = np.cumsum(commons[1] < l)[ranks[1][chosen]]
        order = np.lexsort((chosen, behind, ahead))
        a, b = ahead[order], behind[order]
        again = np.zeros(len(order), bool)
        again[1:] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
        hit = chosen[order[again]]
        which.append(hit)
        offset.append(back[hit] - l)
    return np.concatenate(which), np.concatenate(offset)


_ORDER = np.argsort(SYMBOLS)
_SORTED, _BYTE_OF = SYMBOLS[_ORDER], _ORDER.astype(np.uint8)


def _byte_symbols():
    return lambda text: SYMBOLS[np.frombuffer(text, np.uint8)]


def plan(length: int = LENGTH, gram: int = GRAM, **options: int) -> anchors.Plan:
    return anchors.Plan(length, gram, True, _byte_symbols, repeated_windows, **options)


RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_text: bool = True, **options: int) -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans, kept_sha256 and, on request, kept (the bytes that stay).

    ``options``: ``buffer`` and ``flush`` of ``anchors.Plan``, which bound a task's memory and change no result.
    """
    new = [x.split()[0] for x in RESULT.split(", ")]
    named = docs.drop(*new)
    marked, spans_name = anchors.with_spans(named, plan(length, gram, **options), Scratch(docs.sparkSession, "suffix"))
    names = named.columns if with_text else [c for c in named.columns if c != "text"]
    fields = StructType.fromDDL(RESULT).fields[: None if with_text else -1]
    at_text, at_spans = marked.columns.index("text"), marked.columns.index(spans_name)
    kept_at = [marked.columns.index(c) for c in names]

    def run(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            sizes, removed, spans, digests, kept = [], [], [], [], []
            for text, marks in zip(as_bytes(batch.column(at_text)), batch.column(at_spans).to_pylist(), strict=True):
                text, pairs = text or b"", anchors.merge_spans(marks)
                at, parts = 0, []
                for lo, hi in pairs.tolist():
                    parts.append(text[at:lo])
                    at = hi
                parts.append(text[at:])
                left = b"".join(parts)
                sizes.append(len(text))
                removed.append(len(text) - len(left))
                spans.append(len(pairs))
                digests.append(hashlib.sha256(left).hexdigest())
                kept.append(left if with_text else None)
            columns = [pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string())] + [pa.array(kept, pa.binary())] * with_text
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in kept_at] + columns, names=names + [f.name for f in fields])

    return marked.mapInArrow(tidy(run), StructType(named.select(*names).schema.fields + fields))
