"""Question matching, embeddings, retrieval and answer evaluation."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from markwright.functions import text as tx
from markwright.functions.exprs import ANSWER_LABEL, bands, clamp
from markwright.operators.wordindex import ItemIndex, WordAutomaton, jaccard_score, words_of
from markwright.sources.written import written


INDEX_WORDS = 2_000_000  # words of one broadcast block of items


def _blocks(items: DataFrame) -> list[DataFrame]:
    """``items(id, text)`` in blocks of some ``INDEX_WORDS`` words by a measured total."""
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 + int(total // (6 * INDEX_WORDS))
    part = F.pmod(F.xxhash64("id"), F.lit(n))
    return [items.where(part == k) for k in range(n)] if n > 1 else [items]


def _past_blocks(items: DataFrame, build, passed, label: str) -> DataFrame:
    """Texts past the index of each block: ``passed(broadcast)``. With several blocks each one's rows are written, so that
    one index at a time is held."""
    blocks, out = _blocks(items), None
    for block in blocks:
        index = build([(r["id"], words_of(r["text"])) for r in block.where("id IS NOT NULL").collect()])
        shared = items.sparkSession.sparkContext.broadcast(index)
        found = passed(shared)
        if len(blocks) > 1:
            found = written(found, label)
            shared.destroy()
        out = found if out is None else out.unionByName(found)
    return out


def _texts(rows: DataFrame, id_: str, text: str) -> DataFrame:
    return rows.select(F.col(id_).cast("long").alias("id"), F.col(text).alias("text"))


def _batch(rows: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], names=names)


def ranked_items(docs: DataFrame, items: DataFrame, id_q: str, id_r: str, k: int, by: str, larger_id: bool = False, text: str = "text") -> DataFrame:
    """(q, r, n_q, n_r, shared): for each document the ``k`` items that share most with it, by ``overlap`` (the share of the
    document's tokens) or ``jaccard`` (rounded to four places), ties to the smaller or larger id.

    ``items`` is the stated side (a question bank): its index is broadcast in blocks, documents pass it where they are,
    so that frequent tokens make no pairs to shuffle. Lists of frequent words stay closed once ``k`` items are sure.
    With several blocks there are ``k`` rows for each.
    """
    names, kinds = ["q", "r", "n_q", "n_r", "shared"], [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]

    def task(shared):
        def run(batches):
            index = shared.value
            for batch in batches:
                rows: list[tuple] = []
                for q, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    words = set(words_of(x))
                    found, common = index.best(words, k, by, larger_id)
                    rows += [(q, r, len(words), n, c) for r, n, c in zip(index.ids[found].tolist(), index.sizes[found].tolist(), common.tolist(), strict=True)]
                yield _batch(rows, names, kinds)

        return run

    asked = _texts(docs, id_q, text)
    return _past_blocks(_texts(items, id_r, text), ItemIndex, lambda shared: asked.mapInArrow(task(shared), "q long, r long, n_q int, n_r int, shared int"), "ranked-items")


def ranked_docs(docs: DataFrame, items: DataFrame, id_q: str, id_r: str, k: int, text: str = "text") -> DataFrame:
    """(q, r, score): for each item the ``k`` documents of highest Jaccard (four places), ties to the smaller id.

    Each task keeps the best ``k`` of what it reads, and skips what can't be among them; the rest is a merge of some k
    rows for each item and task.
    """

    def task(shared):
        def run(batches):
            index = shared.value
            best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]  # item, document, score
            least, parts, held = np.zeros(len(index.ids)), [best], 0
            for batch in batches:
                for r, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    words = set(words_of(x))
                    found, common = index.reaching(words, least)
                    if len(found):
                        parts.append([found, np.full(len(found), r), jaccard_score(common, len(words), index.sizes[found])])
                        held += len(found)
                    if held > 4 * k * len(index.ids) + 1000:
                        best = _best(parts, k)
                        parts, held = [best], 0
                        full = np.bincount(best[0], minlength=len(least)) >= k
                        lowest = np.full(len(least), np.inf)
                        np.minimum.at(lowest, best[0], best[2])
                        least = np.where(full, lowest, 0)
            best = _best(parts, k)
            yield pa.RecordBatch.from_arrays([pa.array(index.ids[best[0]]), pa.array(best[1]), pa.array(best[2])], names=["q", "r", "score"])

        return run

    asked = _texts(docs, id_r, text)
    found = _past_blocks(_texts(items, id_q, text), ItemIndex, lambda shared: asked.mapInArrow(task(shared), "q long, r long, score double"), "ranked-docs")
    return found.withColumn("p", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "r"))).where(F.col("p") <= k).drop("p")


def _best(parts: list, k: int) -> list:
    item, doc, score = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((doc, -score, item))
    item, doc, score = item[order], doc[order], score[order]
    new = np.ones(len(item), bool)
    new[1:] = item[1:] != item[:-1]
    at = np.flatnonzero(new)
    keep = np.arange(len(item)) - np.repeat(at, np.diff(np.append(at, len(item)))) < k
    return [item[keep], doc[keep], score[keep]]


def best_jaccard(docs: DataFrame, items: DataFrame, id_q: str, id_r: str) -> DataFrame:
    """(q, r, score): each document's item of highest Jaccard, the smaller id of equal ones."""
    pairs = ranked_items(docs, items, id_q, id_r, 1, "jaccard")
    scored = pairs.select("q", "r", F.round(F.col("shared") / (F.col("n_q") + F.col("n_r") - F.col("shared")), 4).alias("score"))
    return scored.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "r"))).where("place = 1").drop("place")


def match_score(overlap: Column, sequence: Column, number_bonus: Column) -> Column:
    return clamp(0.55 * overlap + 0.30 * sequence + 0.15 * number_bonus)


def rerank_score(embedding: Column, jaccard: Column, hint: Column) -> Column:
    return clamp(0.75 * embedding + 0.20 * jaccard + 0.05 * hint)


def two_stage(pairs: DataFrame, shortlist: int = 10, keep: int = 4) -> DataFrame:
    """Shortlist by the query's overlap, then rerank by overlap and Jaccard; ties go to the larger id."""
    scored = pairs.withColumn("overlap", F.col("shared") / F.col("n_q")).withColumn("jaccard", F.col("shared") / (F.col("n_q") + F.col("n_r") - F.col("shared")))
    first = Window.partitionBy("q").orderBy(F.desc("overlap"), F.desc("r"))
    short = scored.withColumn("p", F.row_number().over(first)).where(F.col("p") <= shortlist)
    final = F.round(rerank_score(F.col("overlap"), F.col("jaccard"), F.lit(0.0)), 4)
    second = Window.partitionBy("q").orderBy(F.desc("score"), F.desc("r"))
    return short.withColumn("score", final).withColumn("place", F.row_number().over(second)).where(F.col("place") <= keep)


def hash_embedding(rows: DataFrame, id_: str, text: str = "text", slots: int = 384) -> DataFrame:
    """Sparse rows (id, slot, value): each token adds a signed one to a hashed slot; values are scaled to length 1.

    Tokens are counted where their text is read, those of many texts in one pass, and each is hashed once for a while;
    nothing is shuffled.
    """

    class Places(dict):
        """Slot and sign of a word as one number: slot, or ~slot for minus."""

        def __missing__(self, word: bytes) -> int:
            h = hashlib.sha256(word).digest()
            slot = int.from_bytes(h[:4]) % slots
            self[word] = out = ~slot if h[4] % 2 else slot
            return out

    def run(batches):
        places = Places()
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                if len(places) > 200_000:
                    places = Places()
                found = [np.fromiter(map(places.__getitem__, words), np.int64, len(words)) for words in map(words_of, batch.column(1).to_pylist())]
                flat = np.concatenate(found)
                key = np.repeat(np.arange(len(found)), [len(x) for x in found]) * slots + np.where(flat < 0, ~flat, flat)
                raw = np.bincount(key, np.where(flat < 0, -1.0, 1.0), minlength=len(found) * slots).reshape(-1, slots)
                row, slot = np.nonzero(raw)
                value = raw[row, slot] / np.sqrt((raw * raw).sum(1))[row]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(slot.astype(np.int32)), pa.array(value)], names=["id", "slot", "value"])

    kind = rows.schema[id_].dataType.simpleString()
    found = rows.select(F.col(id_), F.col(text)).mapInArrow(run, f"id {kind}, slot int, value double")
    return found.select(F.col("id").alias(id_), "slot", F.round("value", 6).alias("value"))


def exact_hits(docs: DataFrame, items: DataFrame, id_q: str, id_r: str, text: str = "text") -> DataFrame:
    """(q, r): documents that hold an item's whole normalised text, at word edges.

    All items stand in one automaton over words (in blocks of measured size), which is broadcast; each text is read once
    where it is. Items without words are in no document.
    """

    def task(shared):
        def run(batches):
            for batch in batches:
                rows = [(q, r) for r, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for q in shared.value.items_in(words_of(x))]
                yield _batch(rows, ["q", "r"], [pa.int64(), pa.int64()])

        return run

    asked = _texts(docs, id_r, text)
    return _past_blocks(_texts(items, id_q, text), WordAutomaton, lambda shared: asked.mapInArrow(task(shared), "q long, r long"), "exact-hits")


def hybrid_search(semantic: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """All exact hits, verified; semantic ones fill up to ``k`` in the order of their score."""
    hits = exact.select("q", "r", F.lit(True).alias("verified"), F.lit(1.0).alias("score"))
    rest = semantic.join(exact.select("q", "r"), ["q", "r"], "left_anti").select("q", "r", F.lit(False).alias("verified"), "score")
    every = hits.unionByName(rest)
    n = F.count_if(F.col("verified")).over(Window.partitionBy("q"))
    place = F.row_number().over(Window.partitionBy("q", "verified").orderBy(F.desc("score"), "r"))
    return every.withColumn("n", n).withColumn("p", place).where(F.col("verified") | (F.col("p") <= F.greatest(F.lit(0), F.lit(k) - F.col("n")))).drop("n", "p")


def point_coverage(answers: DataFrame, at: float, or_shared: int | None, most_points: int | None) -> DataFrame:
    """``answers(id, answer, scheme)``: the share of expected points that the answer covers.

    A point is covered if ``at`` of its tokens occur, or ``or_shared`` of them. With ``most_points`` only the first count.
    """
    points = tx.expected_points(F.col("scheme"))
    points = F.slice(points, 1, most_points) if most_points else points
    said = tx.weighty(F.col("answer"))

    def covered(p: Column) -> Column:
        wanted = tx.weighty(p)
        shared = F.size(F.array_intersect(wanted, said))
        share = F.when(F.size(wanted) == 0, 0.0).otherwise(shared / F.size(wanted))
        return (share >= at) | (shared >= or_shared) if or_shared else share >= at

    n = F.size(points)
    score = F.when(n == 0, 0.0).otherwise(F.size(F.filter(points, covered)) / n)
    out = answers.withColumn("points", n).withColumn("score", F.round(score, 4))
    return out.withColumn("label", bands(F.col("score"), ANSWER_LABEL, "weak"))


def evaluate(answers: DataFrame) -> DataFrame:
    """``answers(id, answer, scheme)`` marked by rule: n_points, score, percent, label, chosen and right option, missing, feedback.

    Where the scheme names an option, the answer's option decides. Otherwise the share of expected points counts that
    the answer covers (40 percent of a point's words, or two of them).
    """
    said, right, chosen = tx.weighty(tx.bare_answer(F.col("answer"))), tx.scheme_option(F.col("scheme")), tx.student_option(F.col("answer"))
    points = tx.expected_points(F.col("scheme"))

    def covered(p: Column) -> Column:
        wanted = tx.weighty(p)
        shared = F.size(F.array_intersect(wanted, said))
        return (shared >= 2) | (F.when(F.size(wanted) == 0, 0.0).otherwise(shared / F.size(wanted)) >= 0.4)

    rows = answers.withColumns({"right_option": right, "option": chosen, "_points": points, "_missing": F.filter(points, lambda p: ~covered(p))})
    mcq, n = F.col("right_option").isNotNull(), F.size("_points")
    worded = ~F.col("scheme").rlike(tx.LONE_OPTION)  # a scheme that is more than a letter is a point besides the option
    share = F.when(n == 0, 0.0).otherwise((n - F.size("_missing")) / n)
    score = F.when(mcq, F.when(F.col("option").eqNullSafe(F.col("right_option")), 1.0).otherwise(0.0)).otherwise(share)
    missed = F.when(mcq, F.when(score == 1.0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("Select option "), F.col("right_option"), F.lit("."))))).otherwise(F.col("_missing"))
    rows = rows.withColumns({"score": F.round(score, 4), "label": bands(score, ANSWER_LABEL, "weak"), "missing": missed, "n_points": F.when(mcq, 1 + worded.cast("int")).otherwise(n)})
    rows = rows.withColumn("percent", F.round(F.col("score") * 100, 2)).withColumn("option", F.when(mcq, F.col("option")))
    return rows.drop("_points", "_missing")


def in_turn(asked: DataFrame, first: Callable[[DataFrame], DataFrame], second: Callable[[DataFrame], DataFrame], key: str) -> DataFrame:
    """``first_source`` of two matchers, the second of which sees only those rows that failed in the first.

    The first one's rows are written, and its failures counted on the way: without any, the second isn't planned.
    """
    failures = Observation()
    done = written(first(asked).observe(failures, F.count_if(F.col("status") == "failed").alias("n")), "first-source")
    if not failures.get["n"]:
        return done.withColumn("fallback_used", F.lit(False))
    failed = done.where("status = 'failed'").select(key)
    return first_source(done, second(asked.join(failed, key, "left_semi")), key)


def first_source(primary: DataFrame, fallback: DataFrame, key: str) -> DataFrame:
    """Rows of the primary source unless their status is failed; else the fallback's; if both fail, the fallback's row with
    the higher confidence of the two."""
    second = fallback.select(F.col(key), *[F.col(c).alias(f"_{c}") for c in fallback.columns if c != key])
    both = primary.join(second, key, "left")
    other = (F.col("status") == "failed") & F.col("_status").isNotNull()
    merged = {c: F.when(other, F.col(f"_{c}")).otherwise(F.col(c)) for c in primary.columns if c not in (key, "confidence")}
    confidence = F.when(other & (F.col("_status") == "failed"), F.greatest("confidence", "_confidence")).when(other, F.col("_confidence")).otherwise(F.col("confidence"))
    return both.select(key, *[c.alias(n) for n, c in merged.items()], confidence.alias("confidence"), other.alias("fallback_used"))


def auto_accept(confidence: Column, warnings: Column, match: Column, margin: Column) -> Column:
    return (confidence >= 0.92) & (F.size(warnings) == 0) & (match >= 0.85) & (margin >= 0.05)


def given_filters(rows: DataFrame, filters: dict, clean: dict | None = None) -> DataFrame:
    """Rows by those filters that have a value, without regard to case; lists allow any of theirs.

    None, and texts that stand for nothing, filter nothing. ``clean``: what is done to a column's values first.
    """
    nothing = {"", "string", "none", "null", "undefined", "n/a", "na"}
    for column, wanted in filters.items():
        every = [w for w in (wanted if isinstance(wanted, list) else [wanted]) if w is not None and str(w).strip().lower() not in nothing]
        if every:
            change = (clean or {}).get(column, lambda c: c)
            hits = [F.lower(F.col(column).cast("string")) == F.lower(change(F.lit(str(w)))) for w in every]
            rows = rows.where(F.exists(F.array(*hits), lambda h: h))
    return rows


def _recent(hits: DataFrame, as_of_year: int, years: int) -> DataFrame:
    """Hits that are questions, of the last calendar years."""
    return hits.where(F.col("number").isNotNull() & (F.coalesce("year", F.lit(0)) >= as_of_year - years + 1))


def occurrences(hits: DataFrame, keys: list[str], as_of_year: int, years: int) -> DataFrame:
    """Where each query's topic was asked: its verified hits if it has any, else all; each question once."""
    some = hits.groupBy("q").agg(F.bool_or("verified").alias("_some"))
    kept = hits.join(some, "q").where(F.col("verified") | ~F.col("_some")).drop("_some")
    return _recent(kept, as_of_year, years).dropDuplicates(["q", *keys])


def examples(hits: DataFrame, keys: list[str], as_of_year: int, years: int, most: int) -> DataFrame:
    """The first questions of each query, each once: verified ones first, then by score."""
    order = [F.desc("verified"), F.desc("score"), "hit"]
    once = _recent(hits, as_of_year, years).withColumn("_u", F.row_number().over(Window.partitionBy("q", *keys).orderBy(*order))).where("_u = 1")
    return once.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("place") <= most).drop("_u")
