"""Exact nearest vectors against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from markwright.operators import vectors


def _clustered(n, dim=16, kinds=25, noise=0.05, seed=1):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(kinds, dim))
    v = centre[rng.integers(0, kinds, n)] + noise * rng.normal(size=(n, dim))
    return v / np.sqrt((v**2).sum(1))[:, None]


def _brute(v, asked, k):
    out = []
    for q in asked:
        score = vectors.cosine_score(v @ v[q])
        best = sorted((-s, r) for r, s in enumerate(score.tolist()) if r != q)[:k]
        out += [(q, r, -s, place) for place, (s, r) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize(("block_rows", "group_rows"), [(64, 1_000_000), (2048, 60)])
def test_all_pairs(spark, block_rows, group_rows):
    v = _clustered(600)
    v[500:540] = v[3]  # copies
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "i long, v array<double>").repartition(3)
    asked = rows.where("i % 20 = 0").select(F.col("i").alias("q"), F.col("v").alias("qv"))
    got = vectors.top_k(asked, rows.select(F.col("i").alias("r"), F.col("v").alias("rv")), 7, block_rows, group_rows)
    assert sorted(map(tuple, got.collect())) == _brute(v, range(0, 600, 20), 7)


def test_few_and_no_rows(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "i long, v array<float>")
    asked, all_ = rows.select(F.col("i").alias("q"), F.col("v").alias("qv")), rows.select(F.col("i").alias("r"), F.col("v").alias("rv"))
    assert sorted(map(tuple, vectors.top_k(asked, all_, 5).collect())) == [(1, 2, 0.5, 1), (2, 1, 0.5, 1)]
    assert vectors.top_k(asked.limit(0), all_, 5).count() == 0 == vectors.top_k(asked, all_.limit(0), 5).count()


def test_most_blocks_of_clustered_vectors_are_skipped():
    v = _clustered(20_000)
    pivots, centres = vectors.spread_out(v[:2000], vectors.PIVOTS), v[2000:2100]
    near = np.argmin(vectors.distances(v, centres), axis=1)
    sample = vectors.cosine_score(v[:200] @ v[:2000].T)
    kth = np.partition(sample, 2000 - 11, axis=1)[:, 2000 - 11]  # its own row may be among them
    queries = vectors.Queries(np.arange(200), v[:200], kth, pivots, 10)
    for c in range(100):
        ids = np.flatnonzero(near == c)
        if len(ids):
            far = vectors.distances(v[ids], pivots)
            queries.meet(ids, v[ids], far.min(0), far.max(0), 1.0)
    query, record, score = queries.prune()
    assert sorted(zip(query.tolist(), record.tolist(), score.tolist(), strict=True)) == sorted(r[:3] for r in _brute(v, range(200), 10))
    assert queries.computed < 0.2 * queries.passed
