"""Benchmark decontamination by multi-pattern search over words, after Wu and Manber.

Patterns are windows of ``window`` consecutive item words (an item of fewer, but not none, is one window). Texts and
items are lower-cased in A-Z and cut into words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. For each pattern length there is a
shift table over blocks of three words (how far a search position may jump), whose size follows from the number of
patterns so that it stays sparse, a table from the hash of a pattern's last block to its patterns, and a direct
comparison of all its words. The positions of many stretches of text jump at once. Equal windows are one pattern.

The patterns of one pass are broadcast, after a measurement of what was built: a benchmark is cut into blocks of items
until each block's tables are below ``BROADCAST_LIMIT``, and the documents pass the blocks one after the other.

Results: null has no words; an item without words has no window; an item with a null id marks words but isn't listed.
Repeated ids count once among the items. Repeated documents get equal results. Other columns pass through unchanged;
columns named like the results are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from markwright.llm.common import BROADCAST_LIMIT, Scratch, as_bytes, chunks, free, mix64, tidy

#: byte -> itself in lower case if it is part of a word, else a space
FOLD = bytes((b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20) for b in range(256))
RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>"
BLOCK = 3
MOST_BITS = 25
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


class Patterns:
    """The windows of one length ``m``: where they begin in ``text`` (word numbers), and their items.

    ``order`` lists the patterns by bucket of their last block, ``begin`` where a bucket starts in it. The items of
    pattern p are ``items[first[p] : first[p + 1]]``.
    """

    def __init__(self, text: np.ndarray, starts: np.ndarray, owners: np.ndarray, m: int):
        self.text, self.length, self.block = text, m, min(BLOCK, m)
        place, opens = _equal_windows(text, starts, m)
        self.starts = starts[place[opens]].astype(np.int32)
        self.items = owners[place].astype(np.int32)
        self.first = np.append(np.flatnonzero(opens), len(place)).astype(np.int32)
        n = len(self.starts)
        bits = lambda most: int(min(MOST_BITS, max(10, np.ceil(np.log2(most)))))
        self.shift_bits, self.bucket_bits = bits(8 * n * (m - self.block + 1)), bits(2 * n)
        self.shift = np.full(1 << self.shift_bits, m - self.block + 1, dtype=np.uint8 if m < 256 else np.int64)
        for end in range(self.block - 1, m):  # shorter jumps come later and stay
            self.shift[self.key(text, self.starts + end, self.shift_bits)] = m - 1 - end
        last = self.key(text, self.starts + m - 1, self.bucket_bits)
        self.order = np.argsort(last, kind="stable").astype(np.int32)
        self.begin = np.searchsorted(last[self.order], np.arange((1 << self.bucket_bits) + 1)).astype(np.int32)

    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.starts, self.items, self.first, self.shift, self.order, self.begin))

    def key(self, text: np.ndarray, last: np.ndarray, bits: int) -> np.ndarray:
        """A hash of the block of words that ends at each place."""
        h = np.zeros(len(last), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(self.block):
                h += text[last - j].astype(np.uint64) * _FACTORS[j]
                h ^= h >> np.uint64(29)
            return ((h * _FACTORS[0]) >> np.uint64(64 - bits)).astype(np.int64)

    def find(self, text: np.ndarray, lane: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """The end position and pattern of each occurrence in ``text`` (word numbers; 0 for words of no pattern)."""
        m, n = self.length, len(text)
        if n < m:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.arange(m - 1, n, lane)
        stop = np.minimum(at + lane, n)
        places, found = [], []
        while len(at):
            jump = self.shift[self.key(text, at, self.shift_bits)].astype(np.int64)
            hit = at[jump == 0]
            if len(hit):
                keys = self.key(text, hit, self.bucket_bits)
                first, many = self.begin[keys].astype(np.int64), (self.begin[keys + 1] - self.begin[keys]).astype(np.int64)
                some = many > 0
                hit, first, many = hit[some], first[some], many[some]
                for lo in range(0, len(hit), 4096):
                    part = slice(lo, lo + 4096)
                    count = many[part]
                    place = np.repeat(hit[part], count)
                    pattern = self.order[np.repeat(first[part] - (np.cumsum(count) - count), count) + np.arange(count.sum())]
                    for j in range(m):
                        same = text[place - j] == self.text[self.starts[pattern] + (m - 1 - j)]
                        place, pattern = place[same], pattern[same]
                    places.append(place)
                    found.append(pattern)
            at = at + np.maximum(jump, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        return (np.concatenate(places), np.concatenate(found)) if places else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _equal_windows(text: np.ndarray, starts: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows sorted so that equal ones are neighbours, and which of them opens a class."""
    seed = 1
    while True:
        h = np.full(len(starts), seed, np.uint64)
        for j in range(m):
            h = mix64(h + text[starts + j].astype(np.uint64))
        place = np.argsort(h, kind="stable")
        opens = np.ones(len(place), bool)
        opens[1:] = h[place[1:]] != h[place[:-1]]
        inner = np.flatnonzero(~opens)
        a, b = starts[place[inner]], starts[place[inner - 1]]
        if all((text[a + j] == text[b + j]).all() for j in range(m)):
            return place, opens
        seed += 1  # unequal windows of equal hash: with other hashes again


class Matcher:
    """All windows of a block of items. ``items``: (id as text or None, text as bytes)."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        self.ids = [item for item, _ in items]
        known, cut = self.vocabulary, []
        for _, text in items:
            cut.append(np.array([known.setdefault(w, len(known) + 1) for w in words_of(text)], np.int32))
        sizes = np.array([len(x) for x in cut], np.int64)
        self.text = np.concatenate(cut) if cut else np.zeros(0, np.int32)
        begins, lengths = np.cumsum(sizes) - sizes, np.minimum(sizes, window)
        self.groups = []
        for m in np.unique(lengths[sizes > 0]).tolist():
            mine = np.flatnonzero(lengths == m)
            many = sizes[mine] - m + 1
            owners = np.repeat(mine, many)
            starts = np.repeat(begins[mine], many) + np.arange(len(owners)) - np.repeat(np.cumsum(many) - many, many)
            self.groups.append(Patterns(self.text, starts, owners, m))

    def nbytes(self) -> int:
        words = sum(len(w) + 110 for w in self.vocabulary)  # with a dict's own share
        return words + self.text.nbytes + 60 * len(self.ids) + sum(g.nbytes() for g in self.groups)

    def scan(self, texts: list[bytes | None]) -> list[tuple[np.ndarray, set[str]]]:
        """For each text its hit marks and the items that occur."""
        get, arrays = self.vocabulary.get, []
        for text in texts:
            words = words_of(text)
            arrays.append(np.fromiter(map(get, words, repeat(0)), dtype=np.int32, count=len(words)))
        gap = np.zeros(1, dtype=np.int32)
        joined = np.concatenate([x for a in arrays for x in (a, gap)]) if arrays else gap
        begins = np.cumsum([0] + [len(a) + 1 for a in arrays])
        edges = np.zeros(len(joined) + 1, dtype=np.int32)
        items: list[set[str]] = [set() for _ in arrays]
        for patterns in self.groups:
            place, pattern = patterns.find(joined)
            np.add.at(edges, place - patterns.length + 1, 1)
            np.add.at(edges, place + 1, -1)
            doc = np.searchsorted(begins, place, side="right") - 1
            for d, p in np.unique(np.stack([doc, pattern]), axis=1).T.tolist() if len(place) else ():
                items[d].update(self.ids[i] for i in patterns.items[patterns.first[p] : patterns.first[p + 1]].tolist())
        marks = np.cumsum(edges[:-1]) > 0
        return [(marks[b : b + len(a)], found - {None}) for b, a, found in zip(begins, arrays, items, strict=False)]


def matchers(rows: list[tuple[str | None, bytes | None]], window: int, limit: int = BROADCAST_LIMIT) -> list[Matcher]:
    """The matcher of the items; of halves of them where it comes out larger than ``limit`` (one item stays whole)."""
    built = Matcher(rows, window)
    if built.nbytes() <= limit or len(rows) < 2:
        return [built]
    del built
    return matchers(rows[: len(rows) // 2], window, limit) + matchers(rows[len(rows) // 2 :], window, limit)


def _blocks(benchmark: DataFrame, block_bytes: int) -> list[DataFrame]:
    """The benchmark in blocks whose texts are below ``block_bytes`` in all (one item alone may be larger)."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("text"))
    total = items.agg(F.sum(F.coalesce(F.length("text"), F.lit(0)))).first()[0] or 0
    n = 1 + 2 * int(total // block_bytes)
    return [items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) for k in range(n)] if n > 1 else [items]


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = BROADCAST_LIMIT // 4, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items_sha256, contaminated and items (the ids) added.

    With several blocks the documents are written between two passes, so that a task holds one block's tables.
    """
    spark = docs.sparkSession
    new = [x.split()[0] for x in RESULT.split(", ")]
    kept = [c for c in docs.columns if c not in new]
    marks, items, copy = (free(n, kept) for n in ("_marks", "_items", "_text"))
    shared = [spark.sparkContext.broadcast(m) for block in _blocks(benchmark, block_bytes) for m in matchers([(r["item"], r["text"]) for r in block.collect()], window, limit)]
    schema = StructType(docs.select(*kept).schema.fields + StructType.fromDDL(RESULT).fields)
    out = docs.select(*kept, F.lit(None).cast("binary").alias(marks), F.array().cast("array<string>").alias(items))
    between, scratch = out.schema, Scratch(spark, "decontaminate")
    for k, matcher in enumerate(shared):
        last = k == len(shared) - 1
        out = out.select("*", F.col("text").alias(copy)).mapInArrow(tidy(_scan_task(matcher, kept, last and new)), schema if last else between)
        if not last:
            out = scratch.save(out, f"pass{k}")
    return out


def _scan_task(shared, kept: list[str], new: list[str] | bool):
    """Marks and items of one block joined to those before; with ``new``, the names of the results, these instead."""

    def run(batches: Iterator):
        import pyarrow as pa

        matcher, n = shared.value, len(kept)
        for batch in batches:
            texts = as_bytes(batch.column(n + 2))
            before, listed = batch.column(n).to_pylist(), batch.column(n + 1).to_pylist()
            rows: list[tuple] = []
            for lo, hi in chunks(texts, 4 << 20):
                for (hit, found), old, ids in zip(matcher.scan(texts[lo:hi]), before[lo:hi], listed[lo:hi], strict=True):
                    if old is not None:
                        hit = hit | np.unpackbits(np.frombuffer(old, np.uint8), count=len(hit)).astype(bool)
                    every = sorted(found.union(ids))
                    hits = int(np.count_nonzero(hit))
                    rows.append((len(hit), hits, len(every), hashlib.sha256(",".join(every).encode()).hexdigest(), hits > 0, every) if new else (np.packbits(hit).tobytes(), every))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.string())] if new else [pa.binary(), pa.list_(pa.string())]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(batch.columns[:n] + columns, names=kept + new if new else batch.schema.names[:-1])

    return run
