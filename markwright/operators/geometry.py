"""Pages as boxes: words swept into lines, points joined with the boxes they lie in, and how long a passage is."""

from __future__ import annotations

import re
from itertools import pairwise

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: fixed values: what is a word, what instructions say, the main band of a page, and how far regions reach beyond a line
WORD = r"[A-Za-z0-9]+(?:['’-][A-Za-z0-9]+)?"
INSTRUCTIONS = ["write a precis", "suggest a suitable title", "suggest title", "précis", "precis", "exercise", "question", "words", "summary"]
_WORD, _OTHER = re.compile(WORD), re.compile("[^A-Za-z0-9]")
TOP, BOTTOM, REACH_X, REACH_Y = 0.08, 0.92, 8.0, 5.0


def word_count(x: Column) -> Column:
    return F.regexp_count(x, F.lit(WORD))


def lines_of(words: DataFrame, page: str) -> DataFrame:
    """``words(page, text, x0, y0, x1, y1)`` with the line that each is on, from 1.

    A sweep down the page: a line begins where a word's upper edge lies at or below all lower edges so far.
    """
    before = Window.partitionBy(page).orderBy("y0", "y1", "x0").rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy(page).orderBy("y0", "y1", "x0").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opened = words.withColumn("_gap", F.coalesce(F.col("y0") >= F.max("y1").over(before), F.lit(True)).cast("int"))
    return opened.withColumn("line", F.sum("_gap").over(so_far)).drop("_gap")


def line_boxes(words: DataFrame, page: str, **more: Column) -> DataFrame:
    """Lines (page, line, text, x0, y0, x1, y1) of words with their lines; ``more``: other aggregates of a line's words."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda w: w["text"]), " ")
    return words.groupBy(page, "line").agg(text.alias("text"), *[F.min(c).alias(c) for c in ("x0", "y0")], *[F.max(c).alias(c) for c in ("x1", "y1")], *[c.alias(n) for n, c in more.items()])


def points_in_boxes(points: DataFrame, boxes: DataFrame, page: str, pad_x: float = 0.0, pad_y: float = 0.0) -> DataFrame:
    """``points(page, x, y, ...)`` that lie in some of the ``boxes(page, x0, y0, x1, y1)``, edges included.

    A range join by grids: a page's cells are as wide and as high as its boxes are by root mean square, so that its boxes
    lie in at most nine cells each on average, and a point in one; points meet the boxes of their cell, and the edges
    decide. All of it goes by page: what is dealt out by page already isn't shuffled again.
    """
    box = F.struct((F.col("x0") - pad_x).alias("x0"), (F.col("y0") - pad_y).alias("y0"), (F.col("x1") + pad_x).alias("x1"), (F.col("y1") + pad_y).alias("y1"))
    spread = boxes.select(F.col(page).alias("_page"), box.alias("_box")).where("_box.x1 >= _box.x0 AND _box.y1 >= _box.y0")
    asked = points.select(F.col(page).alias("_page"), F.struct(*points.columns).alias("_point")).where("_page IS NOT NULL AND _point.x IS NOT NULL AND _point.y IS NOT NULL")
    both = asked.unionByName(spread, allowMissingColumns=True)
    side = lambda a, b: F.greatest(F.sqrt(F.avg(F.pow(F.col(f"_box.{b}") - F.col(f"_box.{a}"), F.lit(2.0))).over(Window.partitionBy("_page"))), F.lit(1e-6))
    cell = lambda v, size: F.floor(v / F.col(size)).cast("long")
    cells = lambda axis, size: F.explode(F.when(F.col("_point").isNull(), F.sequence(cell(F.col(f"_box.{axis}0"), size), cell(F.col(f"_box.{axis}1"), size))).otherwise(F.array(cell(F.col(f"_point.{axis}"), size))))
    celled = both.withColumns({"_w": side("x0", "x1"), "_h": side("y0", "y1")}).withColumn("_cx", cells("x", "_w")).withColumn("_cy", cells("y", "_h"))
    near = celled.withColumn("_near", F.collect_list("_box").over(Window.partitionBy("_page", "_cx", "_cy"))).where("_point IS NOT NULL")
    x, y = F.col("_point.x"), F.col("_point.y")
    return near.where(F.exists("_near", lambda b: x.between(b["x0"], b["x1"]) & y.between(b["y0"], b["y1"]))).select("_point.*")


def is_passage(text: Column) -> Column:
    """A line of running text: no instruction, and five words or three up to a stop."""
    n, low = word_count(text), F.lower(F.trim(text))
    told = F.exists(F.array(*map(F.lit, INSTRUCTIONS)), lambda k: low.contains(k))
    return (low != "") & ~told & ((n >= 5) | ((n >= 3) & F.trim(text).rlike("[.,;:]$")))


def _is_passage(text: str, n: int) -> bool:
    """``is_passage`` of a text with ``n`` words, inside tasks."""
    bare = text.strip(" ")
    if n < 3 or not bare or (n < 5 and bare[-1] not in ".,;:"):
        return False
    low = bare.lower()
    return not any(k in low for k in INSTRUCTIONS)


class Counts(dict):
    """(words, whether it has two letters or digits) of each text; new ones are counted, and all forgotten once they are many."""

    def __missing__(self, text: str | None) -> tuple[int, bool]:
        if len(self) >= 1 << 16:
            self.clear()
        if text is None:
            found = (0, False)
        elif text.isascii() and text.isalnum():
            found = (1, len(text) > 1)
        else:
            found = (len(_WORD.findall(text)), len(_OTHER.sub("", text)) > 1)
        self[text] = found
        return found


def passage_of(texts: list[str | None], x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray, counts: Counts) -> tuple[int, ...]:
    """The numbers of ``passage_words`` for one page's words, in memory linear in them."""
    sweep = np.lexsort((x0, y1, y0))
    opened = np.ones(len(sweep), bool)
    opened[1:] = ~(y0[sweep][1:] < np.fmax.accumulate(y1[sweep])[:-1])
    line = np.empty(len(sweep), np.int64)
    line[sweep] = np.cumsum(opened) - 1
    order = np.lexsort((x0, line))
    if np.any((np.diff(line[order]) == 0) & (np.diff(x0[order]) == 0)):
        order = np.array(sorted(order.tolist(), key=lambda i: (line[i], x0[i], texts[i] or "")))
    texts, line, x0, y0, x1, y1 = [texts[i] for i in order], line[order], x0[order], y0[order], x1[order], y1[order]
    n, clean = (np.array(x) for x in zip(*[counts[t] for t in texts], strict=True))
    begin = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
    low, high, left, right, in_line = np.fmin.reduceat(y0, begin), np.fmax.reduceat(y1, begin), np.fmin.reduceat(x0, begin), np.fmax.reduceat(x1, begin), np.add.reduceat(n, begin)
    height = np.fmax.reduce(y1)
    in_band = lambda y: (y >= height * TOP) & (y <= height * BOTTOM)
    joined = [" ".join(t for t in texts[a:b] if t is not None) for a, b in pairwise([*begin.tolist(), len(texts)])]
    ok = in_band((low + high) / 2) & np.array([_is_passage(t, k) for t, k in zip(joined, in_line.tolist(), strict=True)])
    x, y = (x0 + x1) / 2, (y0 + y1) / 2
    held = np.zeros(len(x), bool)
    left, low, right, high = left[ok] - REACH_X, low[ok] - REACH_Y, right[ok] + REACH_X, high[ok] + REACH_Y
    # lines follow each other down the page: a word's may be those from the first that ends below it to the last that begins above it
    at, last = np.searchsorted(np.fmax.accumulate(high), y, "left"), np.searchsorted(low, y, "right")
    live = np.flatnonzero(at < last)
    while len(live):
        k = at[live]
        held[live] = (x[live] >= left[k]) & (x[live] <= right[k]) & (y[live] >= low[k]) & (y[live] <= high[k])
        at[live] += 1
        live = live[~held[live] & (at[live] < last[live])]
    shown = [t for t, o in zip(joined, ok, strict=True) if o] or joined
    by_lines, in_regions, band, by_text = int(in_line[ok].sum()), int(n[held].sum()), int(n[clean & in_band(y)].sum()), int(n.sum())
    by_length = round((sum(map(len, shown)) + len(shown) - 1) / 5.2)
    good = sorted(v for v in (by_lines, by_lines, in_regions, round(band * 0.80), round(by_length * 0.90), round(by_text * 0.75)) if v > 0)
    words = 0 if not good else good[len(good) // 2] if len(good) % 2 else round((good[len(good) // 2 - 1] + good[len(good) // 2]) / 2.0)
    if words < 80 and by_length >= 100:
        words = max(words, round(by_length * 0.85))
    return words, by_lines, in_regions, band, by_length, by_text


PASSAGE = ("words", "by_lines", "in_regions", "in_band", "by_length", "by_text")


def _passage_task(page: str, words_of):
    """Batches in which a page's rows follow each other -> its passage. ``words_of``: the (pages, texts, boxes) of a batch,
    in parts, where boxes are four arrays."""

    def run(batches):
        import pyarrow as pa

        counts, rows, kind = Counts(), [], None
        held: tuple = (None, [], [])  # the page that may go on in the next part

        def ended():
            if held[1]:
                rows.append((held[0], *passage_of(held[1], *np.concatenate(held[2], axis=1), counts)))

        def told():
            done = [pa.array([r[i] for r in rows], kind if not i else pa.int32()) for i in range(1 + len(PASSAGE))]
            rows.clear()
            return pa.RecordBatch.from_arrays(done, names=[page, *PASSAGE])

        for batch in batches:
            kind = batch.schema.field(page).type
            for own, texts, boxes in words_of(batch):
                if held[0] != own:
                    ended()
                    held = (own, [], [])
                held[1].extend(texts)
                held[2].append(boxes)
                if len(rows) >= 4096:
                    yield told()
        ended()
        if rows:
            yield told()

    return run


def _page_parts(page: str):
    def words_of(batch):
        pages, texts = batch.column(page).to_pylist(), batch.column("text").to_pylist()
        boxes = np.array([batch.column(c).cast("double").to_numpy(zero_copy_only=False) for c in ("x0", "y0", "x1", "y1")])
        edges = [0, *[i for i in range(1, len(pages)) if pages[i] != pages[i - 1]], len(pages)]
        for a, b in pairwise(edges):
            if b > a:
                yield pages[a], texts[a:b], boxes[:, a:b]

    return words_of


def passages_by_page(rows: DataFrame, page: str, words_of) -> DataFrame:
    """``passage_words`` of rows that are dealt out by page, of which ``words_of`` a batch gives the words inside tasks."""
    kind = rows.schema[page].dataType.simpleString()
    ordered = rows.where(F.col(page).isNotNull()).sortWithinPartitions(page)
    return ordered.mapInArrow(_passage_task(page, words_of), f"`{page}` {kind}, " + ", ".join(f"{c} int" for c in PASSAGE))


def passage_words(words: DataFrame, page: str) -> DataFrame:
    """(page, words, by_lines, in_regions, in_band, by_length, by_text): how many words a page's passage has, and the
    estimates it is the middle of: the words of its lines (twice: as runs and as a sum), those within the lines' regions,
    in the page's main band (80 %), by characters (90 %) and by the page's text (75 %). A page is worked out at once."""
    return passages_by_page(words.select(page, "text", "x0", "y0", "x1", "y1").repartition(page), page, _page_parts(page))
