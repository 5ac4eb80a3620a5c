"""Phrase collocations from count streams in prefix and in suffix order.

Each task counts the words and the phrases of its texts by sorting them and hands on one row for each phrase, so that
Spark adds up few large rows. A phrase that is frequent enough has frequent parts, so longer phrases are counted only
where both of their halves are (by a bit set of fixed size: what its collisions let through is counted and goes by its
count). The frequent phrases then stand in two streams: one sorted by their words from the first on, where a phrase
follows its own beginning, one sorted from the last word backwards, where it follows its own end. One pass over each
stream gives the counts of the parts before and after a cut and of the longest extensions on either side; the two
passes meet in a merge join, as do the counts of first and last words.

Results: A-Z are lower-cased; texts are split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those into words ``[^\\x20\\x09]+``.
Null texts are empty, a null lang is ``und``. Every row counts, repeated or not; ids and other columns are ignored. An
empty table, or one without frequent phrases, gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markwright.llm.common import Scratch, as_bytes, hash_words, mix64, tidy

BITS = 27  # of the bit set of frequent pairs: 16 MB
AT_ONCE = 1 << 19  # words that a task counts before it hands rows on
ROWS = 1 << 16  # of one batch
_STOP = b"\xff"  # no byte of UTF-8
#: A-Z to lower case, stops to one byte, tabs to blanks
FOLD = bytes(0xFF if b in b".,;:!?\n\x0b\x0c\r" else 0x20 if b == 9 else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def words_and_stops(text: bytes | None) -> list[bytes]:
    """The words of a text in turn, with ``_STOP`` between pieces."""
    return text.translate(FOLD).replace(_STOP, b" " + _STOP + b" ").split() if text else []


class _Numbers(dict):
    """Words by number, in the order of their first appearance; 0 is the stop."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Texts:
    """Word numbers of texts by language, counted when there are enough."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.numbers, self.held, self.parts = _Numbers({_STOP: 0}), 0, {}

    def add(self, lang: str | None, text: bytes | None) -> None:
        words = words_and_stops(text)
        if words:
            own = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
            self.parts.setdefault("und" if lang is None else lang, []).extend((own, np.zeros(1, np.int64)))
            self.held += len(own)

    def streams(self):
        """(lang, word numbers with 0 at each stop)"""
        for lang, parts in self.parts.items():
            yield lang, np.concatenate(parts)

    def words(self) -> list[bytes]:
        return list(self.numbers)


def _pairs(row: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Where two words of one piece follow each other, and the pair's key."""
    at = np.flatnonzero((row[:-1] > 0) & (row[1:] > 0))
    return at, row[at] * width + row[at + 1]


def pair_slots(lang: str, left: np.ndarray, right: np.ndarray, bits: int) -> np.ndarray:
    """Places of pairs in the bit set, from the hashes of their words."""
    with np.errstate(over="ignore"):
        return (mix64(mix64(left + np.uint64(zlib.crc32(lang.encode()) + 1)) + right) >> np.uint64(64 - bits)).astype(np.int64)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return hash_words([b" ".join(words)])[0]


def _rows(lang: str, grams: pa.Array, counts: np.ndarray):
    """Batches of (lang, gram, c)."""
    for lo in range(0, len(counts), ROWS):
        own = counts[lo : lo + ROWS]
        yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang), len(own)), grams.slice(lo, ROWS).cast(pa.string()), pa.array(own, pa.int64())], names=["lang", "gram", "c"])


def _joined(words: pa.Array, *numbers: np.ndarray) -> pa.Array:
    return pc.binary_join_element_wise(*[words.take(pa.array(n)) for n in numbers], b" ")


def _short_counts(texts: Texts):
    """Counts of words and pairs, and of all words of a language (gram null)."""
    words = pa.array(texts.words(), pa.binary())
    for lang, row in texts.streams():
        own = np.bincount(row, minlength=len(words))
        some = np.flatnonzero(own[1:]) + 1
        yield from _rows(lang, words.take(pa.array(some)), own[some])
        yield from _rows(lang, pa.nulls(1, pa.binary()), own[1:].sum(keepdims=True))
        key, count = np.unique(_pairs(row, len(words))[1], return_counts=True)
        yield from _rows(lang, _joined(words, *np.divmod(key, len(words))), count)


def _long_counts(texts: Texts, frequent: np.ndarray, bits: int):
    """Counts of the phrases of three words whose two pairs are in the bit set."""
    words = texts.words()
    hashes, words = word_hashes(words[1:]), pa.array(words, pa.binary())
    for lang, row in texts.streams():
        at, key = _pairs(row, len(words))
        pair, number = np.unique(key, return_inverse=True)
        slot = pair_slots(lang, hashes[pair // len(words) - 1], hashes[pair % len(words) - 1], bits)
        good = ((frequent[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1).astype(bool)[number]
        first = np.flatnonzero(good[:-1] & good[1:] & (at[1:] == at[:-1] + 1))
        key, count = np.unique(number[first] * len(words) + row[at[first] + 2], return_counts=True)
        begin, last = np.divmod(key, len(words))
        yield from _rows(lang, _joined(words, *np.divmod(pair[begin], len(words)), last), count)


def _count_task(shared, bits: int, at_once: int):
    """Documents (lang, text) -> (lang, gram, c); longer phrases where ``shared`` tells the frequent pairs."""

    def run(batches):
        texts = Texts()
        counts = (lambda t: _long_counts(t, shared.value, bits)) if shared else _short_counts
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                texts.add(lang, text)
                if texts.held >= at_once:
                    yield from counts(texts)
                    texts.clear()
        if texts.held:
            yield from counts(texts)

    return tidy(run)


def _slot_task(bits: int):
    """(lang, gram) of pairs -> their places in the bit set, from 1."""

    def run(batches):
        for batch in batches:
            grams, langs = as_bytes(batch.column(1)), batch.column(0).to_pylist()
            hashes = hash_words(grams)[0].reshape(-1, 2)
            out = np.zeros(len(grams), np.int64)
            for lang in set(langs):
                own = np.array([x == lang for x in langs])
                out[own] = pair_slots(lang, hashes[own, 0], hashes[own, 1], bits) + 1
            yield pa.RecordBatch.from_arrays([pa.array(out)], names=["slot"])

    return run


def _bit_set(pairs: DataFrame, bits: int) -> np.ndarray:
    """The bit set of the pairs; Spark makes it in pages of 32768 bits, of which the driver gets 2**bits bits at most."""
    slots = pairs.select("lang", "gram").mapInArrow(_slot_task(bits), "slot long")
    pages = slots.groupBy(F.bitmap_bucket_number("slot").alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in pages.toLocalIterator():
        own = np.frombuffer(bytes(r["bits"]), np.uint8)[: len(out)]
        out[(r["page"] - 1) * 4096 :][: len(own)] = own
    return out


def _streams(grams: DataFrame) -> DataFrame:
    """(lang, gram, size, a, begin, end, longest) of phrases of two and three words.

    begin and end: the counts of the two first and the two last words of a phrase of three. longest: the count of the
    most frequent phrase of three that a phrase of two begins or ends.
    """
    word = F.split("gram", " ")
    stream = grams.where("size > 1").withColumn("w", word)

    def passed(side: str) -> DataFrame:
        near = (F.element_at("w", 1), F.element_at("w", 2)) if side == "begin" else (F.element_at("w", -1), F.element_at("w", -2))
        far = F.when(F.col("size") == 3, F.element_at("w", 3 if side == "begin" else -3))
        ordered = stream.select("lang", "gram", "size", "a", near[0].alias("w1"), near[1].alias("w2"), far.alias("w3"))
        group = Window.partitionBy("lang", "w1", "w2").orderBy(F.asc_nulls_first("w3"))  # a pair stands before what extends it
        whole = Window.partitionBy("lang", "w1", "w2")
        part = F.when(F.col("size") == 3, F.first("a").over(group.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        extended = F.max(F.when(F.col("size") == 3, F.col("a"))).over(whole)
        return ordered.select("lang", "gram", "size", "a", part.alias(side), F.when(F.col("size") == 2, extended).alias(f"{side}_most"))

    right = passed("end").select(F.col("lang").alias("_lang"), F.col("gram").alias("_gram"), "end", "end_most")
    both = passed("begin").hint("merge").join(right, (F.col("lang") == F.col("_lang")) & (F.col("gram") == F.col("_gram")))
    return both.select("lang", "gram", "size", "a", "begin", "end", F.greatest("begin_most", "end_most").alias("longest"))


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)) in whole numbers of up to 38 digits."""
    big = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", big(a) * big(a) * F.lit(1_000_000).cast("decimal(7,0)"), big(left) * big(right)).cast("long")


def collocations(docs: DataFrame, least: int = 10, keep: int = 2000, inner_percent: int = 50, bits: int = BITS, at_once: int = AT_ONCE) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``keep`` best phrases of two and three words of each language.

    ``least``: the count that makes a phrase a candidate. A candidate inside a longer one that has ``inner_percent`` of
    its count is left out.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "collocations")
    texts = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    summed = lambda found: found.groupBy("lang", "gram").agg(F.sum("c").alias("a")).where((F.col("a") >= least) | F.col("gram").isNull())
    size = (F.length("gram") - F.length(F.translate("gram", " ", "")) + 1).alias("size")
    short = scratch.save(summed(texts.mapInArrow(_count_task(None, bits, at_once), "lang string, gram string, c long")).select("lang", "gram", size, "a"), "short")
    shared = spark.sparkContext.broadcast(_bit_set(short.where("size = 2"), bits))
    longer = scratch.save(summed(texts.mapInArrow(_count_task(shared, bits, at_once), "lang string, gram string, c long")).select("lang", "gram", size, "a"), "longer")
    single = short.where("size = 1").select(F.col("lang").alias("_lang"), F.col("gram").alias("_word"), F.col("a").alias("_a"))
    grams = _streams(short.unionByName(longer))

    def with_word(rows: DataFrame, at: int, name: str) -> DataFrame:
        word = F.element_at(F.split("gram", " "), at)
        own = single.select("_lang", "_word", F.col("_a").alias(name))
        return rows.withColumn("_w", word).hint("merge").join(own, (F.col("lang") == F.col("_lang")) & (F.col("_w") == F.col("_word"))).drop("_w", "_lang", "_word")

    rows = with_word(with_word(grams, 1, "first"), -1, "last")
    three = F.col("size") == 3
    rows = rows.withColumn("one", _score(F.col("a"), F.col("first"), F.when(three, F.col("end")).otherwise(F.col("last"))))
    rows = rows.withColumn("two", F.when(three, _score(F.col("a"), F.col("begin"), F.col("last"))))
    later = F.coalesce(F.col("two") < F.col("one"), F.lit(False))
    cut = {"l": F.when(later, F.col("begin")).otherwise(F.col("first")), "r": F.when(three & ~later, F.col("end")).otherwise(F.col("last")), "score": F.least("one", "two")}
    kept = rows.where(F.coalesce(100 * F.col("longest") < inner_percent * F.col("a"), F.lit(True))).withColumns(cut)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "gram")
    best = kept.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= keep)
    totals = short.where(F.col("gram").isNull()).select(F.col("lang").alias("_lang"), F.col("a").alias("n"))
    found = best.join(totals, F.col("lang") == F.col("_lang"))
    return found.select("lang", "rank", F.col("gram").alias("phrase"), "a", "l", "r", "n", "score")
