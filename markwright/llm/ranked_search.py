"""Ranked lexical search: accumulator-limited term-at-a-time evaluation over an index in shards.

Each task cuts its documents into terms and keeps, in shards, the postings of those terms that some item holds. What
the score needs of the whole corpus (documents, terms, document frequencies) is summed from the shards first. Then each
shard is searched for every item, term at a time, the rarest first. An accumulator is opened for each document of a
term's list, until a document that has none yet could not reach the k-th best partial score by all terms left (the sum
of their largest contributions in this shard); from there on only open accumulators are updated, exactly. The k-th best
of the shards that a task searched before counts as well. The k best of each task are merged by Spark.

The items of one pass are broadcast; more text than ``BLOCK_BYTES`` goes in blocks, of which each passes the documents.

Results: terms are the maximal runs of letters A-Z, digits and characters beyond ASCII, A-Z in lower case; null has
none. Every row of ``docs`` is a document of its own, repeated or not; equal scores go by doc_id, null ids last. Equal
rows of ``items`` are one item; rows of one item_id with other texts are items of their own. Items without terms, or
without a document above 0, have no rows. Other columns of both tables are ignored.
"""

from __future__ import annotations

import math
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from markwright.llm.common import BROADCAST_LIMIT, Scratch, as_bytes, chunks, tidy
from markwright.llm.decontaminate import words_of

BLOCK_BYTES = BROADCAST_LIMIT // 8  # of item texts in one pass
SHARD_POSTINGS = 1 << 20
SHARD = "terms array<int>, counts array<int>, ids array<long>, sizes binary, docs binary, tfs binary, n_docs long, n_terms long"
_SHARD_TYPE = pa.schema([("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())), ("ids", pa.list_(pa.int64())), ("sizes", pa.binary()), ("docs", pa.binary()), ("tfs", pa.binary()), ("n_docs", pa.int64()), ("n_terms", pa.int64())])


def _scan_task(shared):
    """Documents (id, text) -> shards: for each item term its documents and frequencies; documents and terms in all."""

    def run(batches):
        vocabulary = shared.value
        get, width = vocabulary.get, max(1, len(vocabulary))
        ids, sizes, parts, held, n_docs, n_terms = [], [], [], 0, 0, 0

        def flush():
            doc, term, tf = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 3
            order = np.argsort(term, kind="stable")
            terms, counts = np.unique(term, return_counts=True)
            row = {"terms": terms, "counts": counts, "ids": ids, "sizes": np.array(sizes, "<i8").tobytes(), "docs": doc[order].astype("<i4").tobytes(), "tfs": tf[order].astype("<i4").tobytes(), "n_docs": n_docs, "n_terms": n_terms}
            return pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in _SHARD_TYPE], schema=_SHARD_TYPE)

        for batch in batches:
            every, texts = batch.column(0).to_pylist(), as_bytes(batch.column(1))
            for lo, hi in chunks(texts, 4 << 20):
                found = []
                for text in texts[lo:hi]:
                    words = words_of(text)
                    found.append(np.fromiter(map(get, words, repeat(-1)), np.int64, len(words)))
                n = np.array([len(x) for x in found])
                n_docs += int(np.count_nonzero(n))
                n_terms += int(n.sum())
                terms = np.concatenate(found)
                some = terms >= 0
                key, tf = np.unique((np.repeat(np.arange(len(n)), n) * width + terms)[some], return_counts=True)
                mine, at = np.unique(key // width, return_inverse=True)
                parts.append((at + len(ids), key % width, tf))
                ids += [every[lo + i] for i in mine.tolist()]
                sizes += n[mine].tolist()
                held += len(key)
                if held >= SHARD_POSTINGS:
                    yield flush()
                    ids, sizes, parts, held, n_docs, n_terms = [], [], [], 0, 0, 0
        if n_docs:
            yield flush()

    return tidy(run)


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Shard:
    """One shard with the contribution of each posting (without its term's weight) and the largest one of each term."""

    def __init__(self, row: dict, n_docs: int, n_terms: int, width: int):
        self.ids = np.array([0 if i is None else i for i in row["ids"]], np.int64)
        self.no_id = np.array([i is None for i in row["ids"]], bool)
        self.docs = np.frombuffer(row["docs"], "<i4")
        tf, size = np.frombuffer(row["tfs"], "<i4").astype(np.int64), np.frombuffer(row["sizes"], "<i8")
        if len(size) and 90 * int(size.max()) * n_docs >= 1 << 63:
            m = np.array([10 + 90 * int(n) * n_docs // n_terms for n in size], np.int64)
        else:
            m = 10 + 90 * size * n_docs // max(1, n_terms)
        self.part = 1_000_000_000 * tf // (1000 * tf + 8 * m[self.docs])
        counts = np.array(row["counts"], np.int64)
        self.ends = np.cumsum(counts)
        self.begins = self.ends - counts
        self.most = np.maximum.reduceat(self.part, self.begins) if len(counts) else np.zeros(0, np.int64)
        self.slot = np.full(width, -1, np.int64)
        self.slot[row["terms"]] = np.arange(len(counts))
        self.score, self.open = np.zeros(len(self.ids), np.int64), np.zeros(len(self.ids), bool)
        self.opened = 0  # accumulators so far

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(document, score) of the open accumulators above 0 once all terms, rarest first, are done.

        ``least``: the k-th best score known from elsewhere, 0 if there is none."""
        slot = self.slot[terms]
        slot, weights = slot[slot >= 0], weights[slot >= 0]
        bounds = weights * self.most[slot]
        left = np.append(np.cumsum(bounds[::-1])[::-1], 0)
        reached, i = 0, 0
        while i < len(slot) and left[i] >= max(1, least):
            own = slice(self.begins[slot[i]], self.ends[slot[i]])
            docs = self.docs[own]
            self.score[docs] += weights[i] * self.part[own]
            self.open[docs] = True
            reached += int(bounds[i])
            i += 1
            if left[i] < reached:  # else the k-th partial score can't be above what is left
                live = self.score[self.open]
                if len(live) >= k:
                    least = max(least, int(np.partition(live, len(live) - k)[len(live) - k]))
        live = np.flatnonzero(self.open)
        self.opened += len(live)
        for j in range(i, len(slot)):
            own = slice(self.begins[slot[j]], self.ends[slot[j]])
            docs, part = self.docs[own], self.part[own]
            if 16 * len(live) < len(docs):
                at = np.minimum(np.searchsorted(docs, live), len(docs) - 1)
                hit = docs[at] == live
                self.score[live[hit]] += weights[j] * part[at[hit]]
            else:
                hit = self.open[docs]
                self.score[docs[hit]] += weights[j] * part[hit]
        score = self.score[live]
        self.score[live], self.open[live] = 0, False
        return live[score > 0], score[score > 0]


def _search_task(shared, k: int, item_type):
    """Shards -> the k best documents of each item among all shards of the task."""

    def run(batches):
        items, n_docs, n_terms, width = shared.value
        none = np.zeros(0, np.int64)
        best = [(none, none, np.zeros(0, bool)) for _ in items]  # score, id, without id
        for batch in batches:
            for r in range(batch.num_rows):
                shard = Shard(batch.slice(r, 1).to_pylist()[0], n_docs, n_terms, width)
                for q, (_, terms, weights) in enumerate(items):
                    kept, ids, no_id = best[q]
                    docs, score = shard.search(terms, weights, k, int(kept[-1]) if len(kept) == k else 0)
                    if len(docs):
                        score, ids, no_id = np.append(kept, score), np.append(ids, shard.ids[docs]), np.append(no_id, shard.no_id[docs])
                        if len(score) > k:
                            some = score >= np.partition(score, len(score) - k)[len(score) - k]
                            score, ids, no_id = score[some], ids[some], no_id[some]
                        order = np.lexsort((ids, no_id, -score))[:k]
                        best[q] = score[order], ids[order], no_id[order]
        q = np.repeat(np.arange(len(best)), [len(b[0]) for b in best])
        if len(q):
            score, ids, no_id = (np.concatenate(x) for x in zip(*best, strict=True))
            names = ["q", "item_id", "doc_id", "score"]
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array([items[i][0] for i in q.tolist()], item_type), pa.array(ids, mask=no_id), pa.array(score)], names=names)

    return tidy(run)


def _item_blocks(items: DataFrame, block_bytes: int) -> list[DataFrame]:
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 + 2 * int(total // block_bytes)
    return [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b) for b in range(n)]


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` highest-scoring documents of each item, of scores above 0."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    scratch = Scratch(spark, "ranked")
    asked = items.where(F.col("text").isNotNull()).select("item_id", "text").distinct()
    kind = asked.schema["item_id"].dataType
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for b, block in enumerate(_item_blocks(asked, block_bytes)):
        rows = sorted(((r["item_id"], words_of(r["text"].encode())) for r in block.collect()), key=lambda r: (r[0] is None, str(r[0]), r[1]))  # block_bytes at most
        vocabulary = {t: i for i, t in enumerate(sorted({t for _, own in rows for t in own}))}
        index = scratch.save(texts.mapInArrow(_scan_task(spark.sparkContext.broadcast(vocabulary)), SHARD), f"index{b}")
        n_docs, n_terms = (x or 0 for x in index.agg(F.sum("n_docs"), F.sum("n_terms")).first())
        each = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy("x.terms").agg(F.sum("x.counts").alias("df"))
        df = {r["terms"]: r["df"] for r in each.collect()}  # a row for each term of the block's items
        known = []
        for item, own in rows:
            terms = np.array([t for t in {vocabulary[w] for w in own} if t in df], np.int64)
            weights = np.array([term_weight(n_docs, df[t]) for t in terms.tolist()], np.int64)
            order = np.lexsort((terms, -weights))
            known.append((item, terms[order], weights[order]))
        shared = spark.sparkContext.broadcast((known, n_docs, n_terms, max(1, len(vocabulary))))
        found = index.mapInArrow(_search_task(shared, k, to_arrow_type(kind)), f"q int, item_id {kind.simpleString()}, doc_id long, score long")
        rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        top = found.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
        out = top if out is None else out.unionByName(top)
    return out
