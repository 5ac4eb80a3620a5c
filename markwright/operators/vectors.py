"""Exact nearest vectors: blocks of records that their distances to pivots rule out are skipped.

Records stand in blocks, each of vectors nearest to the same one of many centres, with the range of their distances to
every pivot. A vector's distance to a query is at least what its distance to a pivot differs from the query's, so a
block's ranges bound the best score in it from above. Queries are broadcast in groups of bounded size, with the k-th
best score that each has among a sample of the records: a block is computed for those queries alone whose k-th best
score its bound reaches. Records are shuffled once, to their blocks; of a task ``k`` rows for each query leave.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from markwright.sources.written import written

SAMPLE = 8192  # records at most that pivots, centres and first scores come from; it decides what is skipped, not what is found
PIVOTS, CENTRES, BLOCK_ROWS = 16, 2048, 2048
GROUP_BYTES, GROUP_ROWS = 32 << 20, 1_000_000  # of the vectors, and of the results, of one group of queries
SLACK = 1e-9  # more than sums in another order are off by
BLOCK = "ids binary, vectors binary, low array<double>, high array<double>, longest double"


def cosine_score(product: np.ndarray) -> np.ndarray:
    """(cosine + 1) / 2 within 0 and 1, in four places."""
    return np.floor(np.clip((product + 1) / 2, 0, 1) * 10_000 + 0.5) / 10_000


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def _squares(v: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", v, v)


def distances(v: np.ndarray, to: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(_squares(v)[:, None] + _squares(to) - 2 * (v @ to.T), 0))


def spread_out(sample: np.ndarray, m: int) -> np.ndarray:
    """``m`` vectors of the sample, each the farthest from those before it."""
    chosen, far = [0], np.full(len(sample), np.inf)
    for _ in range(min(m, len(sample)) - 1):
        far = np.minimum(far, distances(sample, sample[chosen[-1:]])[:, 0])
        chosen.append(int(np.argmax(far)))
    return sample[chosen]


class Queries:
    """A group of queries with the best that they have found. ``computed`` and ``passed`` count blocks for each query."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, kth: np.ndarray, pivots: np.ndarray, k: int):
        self.ids, self.vectors, self.kth, self.k = ids, vectors, kth.copy(), k
        self.squares, self.to_pivots = _squares(vectors), distances(vectors, pivots)
        self.found: list[tuple] = []
        self.held = self.computed = self.passed = 0

    def bounds(self, low: np.ndarray, high: np.ndarray, longest: float, part: slice) -> np.ndarray:
        """The highest score that each query can have with anything in a block."""
        own = self.to_pivots[part]
        gap = np.maximum(np.maximum(low - own, own - high), 0).max(1)
        return cosine_score((self.squares[part] + longest - gap * gap) / 2 + SLACK * (1 + self.squares[part] + longest))

    def meet(self, ids: np.ndarray, vectors: np.ndarray, low: np.ndarray, high: np.ndarray, longest: float) -> None:
        for lo in range(0, len(self.ids), 512):
            part = slice(lo, lo + 512)
            open_ = lo + np.flatnonzero(self.bounds(low, high, longest, part) >= self.kth[part])
            self.passed += min(512, len(self.ids) - lo)
            self.computed += len(open_)
            if not len(open_):
                continue
            score = cosine_score(self.vectors[open_] @ vectors.T)
            score[self.ids[open_][:, None] == ids[None, :]] = -1  # not with itself
            if len(ids) >= self.k:
                best = np.partition(score, len(ids) - self.k, axis=1)[:, len(ids) - self.k]
                self.kth[open_] = np.maximum(self.kth[open_], best)
            row, column = np.nonzero(score >= np.maximum(self.kth[open_], 0)[:, None])
            self.found.append((open_[row], ids[column], score[row, column]))
            self.held += len(row)
        if self.held > 2 * self.k * len(self.ids) + 100_000:
            self.prune()

    def prune(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, record, score) of the ``k`` best so far, ties to the smaller record."""
        none = np.zeros(0, np.int64)
        query, record, score = (np.concatenate(x) for x in zip(*self.found, (none, none, np.zeros(0)), strict=True))
        order = np.lexsort((record, -score, query))
        query, record, score = query[order], record[order], score[order]
        begin = np.flatnonzero(np.append(True, query[1:] != query[:-1])) if len(query) else none
        nth = np.arange(len(query)) - np.repeat(begin, np.diff(np.append(begin, len(query))))
        last = nth == self.k - 1
        self.kth[query[last]] = np.maximum(self.kth[query[last]], score[last])
        top = nth < self.k
        self.found, self.held = [(query[top], record[top], score[top])], int(top.sum())
        return query[top], record[top], score[top]


def _block_task(centres: np.ndarray, pivots: np.ndarray):
    def nearest(batches):
        for batch in batches:
            if batch.num_rows:
                v = _matrix(batch.column("rv"))
                centre = np.concatenate([np.argmin(distances(v[lo : lo + 1024], centres), axis=1) for lo in range(0, len(v), 1024)])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(centre.astype(np.int32))], names=["r", "rv", "centre"])

    def block(table: pa.Table) -> pa.Table:
        v = _matrix(table.column("rv"))
        far = distances(v, pivots)
        row = {"ids": table.column("r").to_numpy().astype("<i8").tobytes(), "vectors": v.astype("<f8").tobytes(), "low": far.min(0).tolist(), "high": far.max(0).tolist(), "longest": float(_squares(v).max())}
        kinds = [("ids", pa.binary()), ("vectors", pa.binary()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())), ("longest", pa.float64())]
        return pa.Table.from_pylist([row], schema=pa.schema(kinds))

    return nearest, block


def _first_scores(sample_ids: np.ndarray, sample: np.ndarray, k: int):
    """Queries with the k-th best score that they have among the sample, -1 where it is too small."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, v = batch.column("q").to_numpy(), _matrix(batch.column("qv"))
            kth = np.full(len(ids), -1.0)
            for lo in range(0, len(ids), 256):
                score = cosine_score(v[lo : lo + 256] @ sample.T)
                score[ids[lo : lo + 256, None] == sample_ids[None, :]] = -1
                if score.shape[1] >= k:
                    kth[lo : lo + 256] = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kth)], names=["q", "qv", "kth"])

    return run


def _search_task(shared, pivots: np.ndarray, k: int):
    def run(batches):
        ids, vectors, kth = shared.value
        queries = Queries(ids, vectors, kth, pivots, k)
        for batch in batches:
            for row in batch.to_pylist():
                own = np.frombuffer(row["ids"], "<i8")
                queries.meet(own, np.frombuffer(row["vectors"], "<f8").reshape(len(own), -1), np.array(row["low"]), np.array(row["high"]), row["longest"])
        query, record, score = queries.prune()
        yield pa.RecordBatch.from_arrays([pa.array(ids[query]), pa.array(record), pa.array(score)], names=["q", "r", "score"])

    return run


def top_k(queries: DataFrame, records: DataFrame, k: int, block_rows: int = BLOCK_ROWS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``(q, qv)`` against ``(r, rv)``: (q, r, score, place) of the ``k`` largest (cosine + 1) / 2 for each query, its own row
    left out; of equal scores, in four places, the smaller record. Vectors are unit vectors of one length."""
    spark = records.sparkSession
    records = records.select(F.col("r").cast("long").alias("r"), F.col("rv").cast("array<double>").alias("rv"))
    queries = queries.select(F.col("q").cast("long").alias("q"), F.col("qv").cast("array<double>").alias("qv"))
    total = records.count()
    schema = "q long, r long, score double, place int"
    if not total:
        return spark.createDataFrame([], schema)
    share = F.pmod(F.xxhash64(F.lit(11), "r"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, 0.9 * SAMPLE / total))
    rows = sorted(records.where(share).limit(SAMPLE).collect(), key=lambda row: row["r"]) or records.limit(1).collect()
    sample_ids, sample = np.array([row["r"] for row in rows]), np.array([row["rv"] for row in rows], dtype=np.float64)
    pivots = spread_out(sample, PIVOTS)
    centres = np.random.default_rng(3).permutation(sample)[: max(1, min(CENTRES, total // block_rows))]
    nearest, block = _block_task(centres, pivots)
    if len(centres) > 1:
        placed = written(records.mapInArrow(nearest, "r long, rv array<double>, centre int"), "vectors-placed")
        parts = placed.groupBy(F.col("centre").alias("c")).agg(F.ceil(F.count("*") / block_rows).alias("parts"))
        dealt = placed.join(F.broadcast(parts), F.col("centre") == F.col("c"))  # CENTRES rows at most
    else:
        dealt = records.withColumns({"centre": F.lit(0), "parts": F.lit(1 + total // block_rows)})
    blocks = written(dealt.groupBy("centre", F.pmod(F.xxhash64("r"), F.col("parts")).alias("part")).applyInArrow(_drop_keys(block), BLOCK), "vectors-blocks")
    asked, wanted = queries.mapInArrow(_first_scores(sample_ids, sample, k), "q long, qv array<double>, kth double"), queries.count()
    n = 1 + max(wanted * sample.shape[1] * 8 // GROUP_BYTES, wanted * k // group_rows)
    asked = written(asked, "vectors-asked") if n > 1 else asked
    out = None
    for g in range(n):
        group = asked.where(F.pmod(F.xxhash64("q"), F.lit(n)) == g).collect()  # some GROUP_BYTES
        if not group:
            continue
        shared = spark.sparkContext.broadcast((np.array([r["q"] for r in group]), np.array([r["qv"] for r in group], dtype=np.float64), np.array([r["kth"] for r in group])))
        found = blocks.mapInArrow(_search_task(shared, pivots, k), "q long, r long, score double")
        if n > 1:
            found = written(found, "vectors-found")
            shared.destroy()
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], schema)
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "r"))
    return out.withColumn("place", place).where(F.col("place") <= k).select("q", "r", "score", "place")


def _drop_keys(block):
    return lambda table: block(table.select(["r", "rv"]))
