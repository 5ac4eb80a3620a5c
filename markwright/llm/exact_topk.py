"""Exact top-k search by inner product with a table of pivot distances.

Vectors are turned into whole numbers first (``floor(scale * x)``), so that scores are exact. With d the distance of two
vectors, <q, x> = (|q|^2 + |x|^2 - d^2) / 2, and by the triangle inequality d is at least |d(q, p) - d(x, p)| for every
pivot p. Each vector has its distances to all pivots in a table; the largest of the lower bounds gives the highest score
that a candidate can reach. A query takes its candidates in the order of these bounds, evaluates them on all components,
and stops once the next bound is below its k-th best score: nothing beyond it can be among the best.

Vectors stand in packs, each of vectors that are nearest to the same one of many centres, with the range of each pivot
distance in it. A query first searches the packs of its own centre; the k-th best from there tells which other packs may
hold something better. Equal vectors are one entry; of their ids the k + 1 smallest can be among a query's best.

Pivots and centres come from a sample of ``SAMPLE`` vectors at most. They decide how much is skipped, never the results.

Results: null ids, and vectors that are null, of another length than most, or hold null or non-finite numbers take no
part, neither as queries nor as candidates; zero vectors do. Rows that repeat an id and its vector are one; of rows of
one id with different vectors the smallest vector, by its components in turn, counts. With fewer candidates than ``k``
all are returned; equal scores go to the smaller id. Scores have to be below 2**63. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markwright.llm.common import Scratch

PIVOTS = 32
CENTRES = 4096  # most of them; their packs' ranges go to all tasks
PACK_ROWS = 2048
SAMPLE = 16_384
QUERIES_AT_ONCE = 16_384
ROUND = 64  # candidates of a query that are evaluated before its bound is looked at again
EXACT = float(1 << 53)
SLACK = 1e-9  # of the squared lengths: more than sums of rounded numbers are off by


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def _squares(v: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", v, v)


def distances(v: np.ndarray, to: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(_squares(v)[:, None] + _squares(to)[None, :] - 2 * (v @ to.T), 0))


def choose_pivots(sample: np.ndarray, m: int) -> np.ndarray:
    """Vectors far from each other: each next one has the largest distance to those before."""
    far, chosen = np.full(len(sample), np.inf), [0]
    while len(chosen) < min(m, len(sample)):
        far = np.minimum(far, distances(sample, sample[chosen[-1:]])[:, 0])
        chosen.append(int(np.argmax(far)))
    return sample[chosen]


def exact_scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products of rows with rows, as 64-bit integers."""
    most = max(1.0, np.abs(queries).max(initial=0) * np.abs(vectors).max(initial=0)) * queries.shape[1]
    if most < EXACT:
        return np.einsum("ij,ij->i", queries, vectors).astype(np.int64)
    whole = [[sum(int(a) * int(b) for a, b in zip(q, v, strict=True))] for q, v in zip(queries, vectors, strict=True)]
    return np.array(whole, np.int64).reshape(-1)


class Pack:
    """Vectors with their pivot table; ``evaluated`` counts the pairs that were looked at on all components."""

    def __init__(self, vectors: np.ndarray, pivots: np.ndarray):
        self.vectors, self.pivots, self.squares = vectors, pivots, _squares(vectors)
        self.table = distances(vectors, pivots)
        self.slack = SLACK * max(1.0, self.squares.max(initial=0), _squares(pivots).max(initial=0))
        self.evaluated = 0

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The highest score that each vector can have with each query."""
        own = distances(queries, self.pivots)
        gap = np.zeros((len(queries), len(self.vectors)))
        for p in range(len(self.pivots)):
            np.maximum(gap, np.abs(own[:, p : p + 1] - self.table[:, p]), out=gap)
        square = _squares(queries)
        return (square[:, None] + self.squares[None, :] - gap * gap) / 2 + self.slack + SLACK * square[:, None]

    def search(self, queries: np.ndarray, known: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, vector) of all pairs that may be among the query's ``k`` best: those that reach its k-th best score,
        of this pack or ``known``."""
        n = len(self.vectors)
        bounds = self.bounds(queries)
        order = np.argsort(-bounds, axis=1)
        kth, best = known.astype(np.float64).copy(), np.full((len(queries), k), -np.inf)
        slack = self.slack + SLACK * _squares(queries)
        live, found = np.arange(len(queries)), []
        for lo in range(0, n, ROUND):
            live = live[bounds[live, order[live, lo]] >= kth[live]]
            if not len(live):
                break
            at = order[live, lo : lo + ROUND]
            score = np.matmul(self.vectors[at], queries[live][:, :, None])[:, :, 0]
            self.evaluated += score.size
            best[live] = -np.partition(-np.concatenate([best[live], score], axis=1), k - 1, axis=1)[:, :k]
            kth[live] = np.maximum(kth[live], best[live].min(1) - slack[live])
            row, column = np.nonzero(score >= kth[live][:, None])
            found.append((live[row], at[row, column], score[row, column]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        query, place, score = (np.concatenate(x) for x in zip(*found, strict=True))
        some = score >= kth[query]
        return query[some], place[some]


PACK = "centre int, pack int, vectors binary, ids binary, counts binary, low array<double>, high array<double>, longest double"


def _centre_task(centres: np.ndarray):
    """Rows with their nearest centre. The vectors stand in column v."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                v = _matrix(batch.column("v"))
                near = np.concatenate([np.argmin(distances(v[lo : lo + 1024], centres), axis=1) for lo in range(0, len(v), 1024)])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32))], names=[*batch.schema.names, "centre"])

    return run


def _pack_task(k: int, pivots: np.ndarray):
    """Rows of one pack (centre, pack, v, ids) -> its vectors, ids and ranges."""

    def run(table):
        vectors = _matrix(table.column("v"))
        ids = np.full((len(vectors), k + 1), -1, "<i8")
        for i, own in enumerate(table.column("ids").to_pylist()):
            ids[i, : len(own)] = sorted(own)
        counts, far = np.array([len(x) for x in table.column("ids").to_pylist()], "<i4"), distances(vectors, pivots)
        row = {"centre": table.column("centre")[0].as_py(), "pack": table.column("pack")[0].as_py(), "vectors": vectors.astype("<f8").tobytes(), "ids": ids.tobytes(), "counts": counts.tobytes(), "low": far.min(0).tolist(), "high": far.max(0).tolist(), "longest": float(_squares(vectors).max())}
        schema = pa.schema([("centre", pa.int32()), ("pack", pa.int32()), *((n, pa.binary()) for n in ("vectors", "ids", "counts")), *((n, pa.list_(pa.float64())) for n in ("low", "high")), ("longest", pa.float64())])
        return pa.Table.from_pylist([row], schema=schema)

    return run


def pack_bounds(queries: np.ndarray, pivots: np.ndarray, low: np.ndarray, high: np.ndarray, longest: np.ndarray) -> np.ndarray:
    """The highest score that anything in each pack can have with each query."""
    own, gap = distances(queries, pivots), np.zeros((len(queries), len(low)))
    for p in range(len(pivots)):
        q = own[:, p : p + 1]
        np.maximum(gap, np.maximum(low[:, p] - q, q - high[:, p]), out=gap)
    square = _squares(queries)[:, None]
    return (square + longest - gap * gap) / 2 + SLACK * (square + longest + _squares(pivots).max(initial=1))


def _route_task(pivots: np.ndarray, shared):
    """Queries (id, v, centre, known) -> (id, centre, known) for each other centre that may hold something as good."""

    def run(batches):
        numbers, low, high, longest = shared.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                known = batch.column("known").to_numpy(zero_copy_only=False)
                open_ = pack_bounds(_matrix(batch.column("v")), pivots, low, high, longest) >= known[:, None]
                open_ &= numbers[None, :] != batch.column("centre").to_numpy()[:, None]
                row, column = np.nonzero(open_)
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(row)), pa.array(numbers[column].astype(np.int32)), pa.array(known[row])], names=["id", "centre", "known"])

    return run


def _search_task(k: int, pivots: np.ndarray):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64),) * 3]
        if left.num_rows and right.num_rows:
            dim = pivots.shape[1]
            pack = Pack(np.frombuffer(left.column("vectors")[0].as_py(), "<f8").reshape(-1, dim), pivots)
            ids = np.frombuffer(left.column("ids")[0].as_py(), "<i8").reshape(-1, k + 1)
            counts = np.frombuffer(left.column("counts")[0].as_py(), "<i4")
            every, known, asked = _matrix(right.column("v")), right.column("known").to_numpy(), right.column("id").to_numpy()
            for lo in range(0, len(every), 128):
                queries = every[lo : lo + 128]
                row, at = pack.search(queries, known[lo : lo + 128], k + 1)
                score = exact_scores(queries[row], pack.vectors[at])
                each = np.repeat(np.arange(len(at)), counts[at])
                nth = np.arange(len(each)) - np.repeat(np.cumsum(counts[at]) - counts[at], counts[at])
                query, found, value = asked[lo + row[each]], ids[at[each], nth], score[each]
                other = query != found
                query, found, value = query[other], found[other], value[other]
                order = np.lexsort((found, -value, query))
                query, found, value = query[order], found[order], value[order]
                begin = np.flatnonzero(np.append(True, query[1:] != query[:-1])) if len(query) else np.zeros(0, np.int64)
                top = np.arange(len(query)) - np.repeat(begin, np.diff(np.append(begin, len(query)))) < k
                out.append((query[top], found[top], value[top]))
        q, v, s = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(s, pa.int64())})

    return run


def _whole(rows: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v): usable rows, one for each id, with whole-numbered vectors."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = rows.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).where(finite)
    floor = F.transform(v, lambda x: F.floor(x * scale).cast("double"))
    return kept.select(F.col(id_col).cast("long").alias("id"), floor.alias("v")).groupBy("id").agg(F.min("v").alias("v"))


def top_scores(rows: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", pack_rows: int = PACK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest of all other rows for each row where ``is_query`` (on ``id``)."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "topk")
    usable = scratch.save(_whole(rows, id_col, vector_col, scale), "usable")
    common = usable.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None or not common["d"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    usable = usable.where(F.size("v") == common["d"])
    first = Window.partitionBy("v").orderBy("id")
    entries = usable.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1).groupBy("v").agg(F.collect_list("id").alias("ids"))
    entries = scratch.save(entries, "entries")
    n = entries.count()
    share = F.pmod(F.xxhash64(F.lit(5), "v"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, 0.9 * SAMPLE / n))
    sample = np.array(sorted(r["v"] for r in entries.where(share).select("v").limit(SAMPLE).collect()) or [entries.first()["v"]], dtype=float)
    sample = np.random.default_rng(7).permutation(sample)
    pivots, centres = choose_pivots(sample, PIVOTS), sample[: max(1, min(CENTRES, n // pack_rows))]
    placed = scratch.save(entries.mapInArrow(_centre_task(centres), "v array<double>, ids array<long>, centre int"), "placed")
    packs = placed.groupBy(F.col("centre").alias("c")).agg(F.ceil(F.count("*") / pack_rows).alias("packs"))
    dealt = placed.join(F.broadcast(packs), F.col("centre") == F.col("c"))  # CENTRES rows at most
    dealt = dealt.select("centre", F.pmod(F.xxhash64("v"), F.col("packs")).cast("int").alias("pack"), "v", "ids")
    index = scratch.save(dealt.groupBy("centre", "pack").applyInArrow(_pack_task(k, pivots), PACK), "index")
    scratch.drop("entries", "placed")
    queries = usable.where(is_query).mapInArrow(_centre_task(centres), "id long, v array<double>, centre int")
    queries = scratch.save(queries, "queries")
    turns = 1 + queries.count() // QUERIES_AT_ONCE

    def search(asked: DataFrame, name: str) -> DataFrame:
        """``asked`` (id, centre, known): the k best in the packs of that centre."""
        right = asked.join(scratch.load("queries").select("id", "v"), "id").withColumn("turn", F.pmod(F.xxhash64("id"), F.lit(turns)).cast("int"))
        right = scratch.save(scratch.load("index").select("centre", "pack").join(right, "centre"), name)
        left = index.join(scratch.load(name).select("centre", "pack", "turn").distinct(), ["centre", "pack"])
        keys = ("centre", "pack", "turn")
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_search_task(k, pivots), "query_id long, vec_id long, score long")

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    top = lambda found: found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    nothing = F.lit(float("-inf"))
    near = scratch.save(top(search(queries.select("id", "centre", nothing.alias("known")), "asked")), "near")
    known = near.groupBy(F.col("query_id").alias("q")).agg(F.when(F.count("*") == k, F.min("score")).cast("double").alias("kth"))
    asked = queries.join(known, F.col("id") == F.col("q"), "left").select("id", "v", "centre", F.coalesce("kth", nothing).alias("known"))
    m = len(pivots)
    edges = [(F.min if end == "low" else F.max)(F.col(end)[j]).alias(f"{end}{j}") for end in ("low", "high") for j in range(m)]
    ranges = np.array(sorted(tuple(r) for r in index.groupBy("centre").agg(*edges, F.max("longest").alias("longest")).collect()), dtype=float)  # CENTRES rows at most
    shared = spark.sparkContext.broadcast((ranges[:, 0].astype(int), ranges[:, 1 : 1 + m], ranges[:, 1 + m : 1 + 2 * m], ranges[:, -1]))
    routed = scratch.save(asked.mapInArrow(_route_task(pivots, shared), "id long, centre int, known double"), "routed")
    found = near.drop("rank").unionByName(search(routed, "asked_again"))
    return top(found).select("query_id", "rank", "vec_id", "score")
