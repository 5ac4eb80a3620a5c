"""Ranked search, collocations and exact top-k against brute force."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from markwright.llm import collocations, exact_topk, ranked_search


def _ranked(docs, items, k=10):
    cut = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(i, Counter(cut(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in {(i, t) for i, t in items if t is not None}:
        scored = []
        for i, c in held:
            m = 10 + 90 * sum(c.values()) * n_docs // total
            weight = lambda t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
            score = sum(weight(t) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(cut(text)) if c[t])
            if score:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def _corpus(n, seed=1):
    rng = np.random.default_rng(seed)
    words = [f"w{int(k)}" for k in rng.zipf(1.3, 40_000) % 3000]
    return [(i, " ".join(words[j] for j in rng.integers(0, len(words), rng.integers(1, 60)))) for i in range(n)]


@pytest.mark.parametrize("shard", [40, 1 << 20])
def test_ranked_search_finds_what_scoring_all_finds(spark, monkeypatch, shard):
    monkeypatch.setattr(ranked_search, "SHARD_POSTINGS", shard)
    docs = _corpus(400) + [(7, "w1 W2 w3"), (7, "w1 W2 w3"), (None, "w1 w2 w3"), (None, "w1 w2 w3"), (401, None), (402, ""), (403, "., -"), (404, "É1é w5 é"), (405, "w2 " * 30_000), *[(500 + i, "w9 w10 copy") for i in range(300)]]
    items = [(0, "w1 w2, W3 w2"), (1, "w9 w10 copy"), (1, "w9 w10 copy"), (1, "w4"), (2, None), (3, ""), (4, "unknown"), (5, "é1é w5"), (None, "w1"), (6, " ".join(f"w{i}" for i in range(200)))]
    frame = spark.createDataFrame([(i, t, 0, "x") for i, t in docs], "doc_id long, text string, score int, q string").repartition(5)
    asked = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, rank string")
    for block in (1 << 20, 60):
        got = ranked_search.ranked(frame, asked, block_bytes=block)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(map(tuple, got.collect()), key=str) == _ranked(docs, items)


def test_ranked_search_of_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id int, text string"), spark.createDataFrame([("x", "a")], "item_id string, text string")
    assert ranked_search.ranked(docs.limit(0), items).count() == 0
    assert ranked_search.ranked(docs, items.limit(0)).count() == 0
    assert ranked_search.ranked(docs.limit(0), items.limit(0)).dtypes == [("item_id", "string"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert [tuple(r)[:3] for r in ranked_search.ranked(docs, items).collect()] == [("x", 1, 1)]


def test_frequent_terms_open_few_accumulators():
    n = 5000
    docs = [np.arange(n), np.arange(0, n, 2), np.arange(0, n, 200)]  # of a frequent, a common and a rare term
    row = {"terms": [0, 1, 2], "counts": [len(d) for d in docs], "ids": list(range(n)), "sizes": np.full(n, 10, "<i8").tobytes(), "docs": np.concatenate(docs).astype("<i4").tobytes(), "tfs": np.ones(sum(map(len, docs)), "<i4").tobytes()}
    shard = ranked_search.Shard(row, n, 10 * n, 3)
    weights = np.array([ranked_search.term_weight(n, len(d)) for d in docs])
    live, score = shard.search(np.array([2, 1, 0]), weights[[2, 1, 0]], 10, 0)
    assert shard.opened == 25 and len(live) == 25
    assert (score == sum(w * (10**9 // (1000 + 800)) for w in weights.tolist())).all()
    assert len(shard.search(np.array([2, 1, 0]), weights[[2, 1, 0]], 10, int(score[0]) + 1)[0]) == 0 and shard.opened == 25


def _phrases(docs, least, keep, percent=50):
    f, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, own in f.items():
        found = []
        cand = {g: a for g, a in own.items() if len(g) > 1 and a >= least}
        for g, a in cand.items():
            if any(100 * b >= percent * a and g in (h[:2], h[1:]) for h, b in cand.items() if len(h) > len(g)):
                continue
            score, k = min((10**6 * a * a // (own[g[:k]] * own[g[k:]]), k) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), own[g[:k]], own[g[k:]]))
        out += [(lang, r, g.decode(), -a, x, y, n[lang], -s) for r, (s, a, g, x, y) in enumerate(sorted(found)[:keep], 1)]
    return sorted(out)


@pytest.mark.parametrize(("bits", "at_once"), [(27, 1 << 21), (12, 500)])
def test_collocations_are_those_of_counting_all(spark, bits, at_once):
    rng = np.random.default_rng(5)
    words = ["of", "the", "New", "york", "city", "É", "a\x00b", "x y", "日本", '"q"'] + [f"w{i}" for i in range(40)]
    text = lambda: "".join(words[i] + " .,\t\n"[j] + " " * (i % 2) for i, j in zip(rng.zipf(1.4, 200) % len(words), rng.choice(5, 200, p=[0.8, 0.05, 0.05, 0.05, 0.05]), strict=True))
    docs = [(lang, text()) for lang in ("en", "en", "fr", None, "und", "") for _ in range(12)]
    docs += [("en", "new york city\n" * 40), ("en", None), ("fr", ""), ("en", "new york, city! of the; the of"), *[("copies", "one two three four")] * 300, ("rare", "only once here")]
    frame = spark.createDataFrame([(0, t, lang, "g", 1) for lang, t in docs], "doc_id int, text string, lang string, gram string, c int").repartition(4)
    for least, keep in ((10, 2000), (2, 25)):
        got = collocations.collocations(frame, least=least, keep=keep, bits=bits, at_once=at_once)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(map(tuple, got.collect())) == _phrases(docs, least, keep)
    assert collocations.collocations(frame.limit(0)).count() == 0
    assert collocations.collocations(frame.where("lang = 'rare'")).count() == 0


def test_scores_beyond_64_bits_are_exact(spark):
    a, left, right = 3_000_000_000_001, 3_000_000_000_007, 9_000_000_000_011
    row = spark.createDataFrame([(a, left, right)], "a long, l long, r long").select(collocations._score(*map(collocations.F.col, "alr")).alias("s")).first()
    assert row["s"] == 10**6 * a * a // (left * right)


def _top(rows, every, k, scale=256):
    finite = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    whole = defaultdict(list)
    for i, v in rows:
        if i is not None and finite(v):
            whole[i].append([math.floor(scale * float(x)) for x in v])
    whole = {i: min(v) for i, v in whole.items()}
    out = []
    for q in (i for i in whole if i % every == 0):
        best = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q)[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("pack_rows", [16, 2048])
def test_exact_topk_is_that_of_all_pairs(spark, pack_rows):
    rng = np.random.default_rng(2)
    near = rng.normal(size=(6, 8))
    rows = [(i, (near[i % 6] + 0.1 * rng.normal(size=8)).tolist()) for i in range(300)]
    rows += [(1000 + i, near[0].tolist()) for i in range(150)]  # copies
    rows += [(5, rows[5][1]), (6, rows[7][1]), (10, None), (2000, [1.0, None, *[0.0] * 6]), (2010, [float("nan")] * 8), (2020, [float("inf")] * 8), (None, near[1].tolist()), (2030, [0.0] * 8), (2031, [1000.0] * 8)]
    frame = spark.createDataFrame([(i, v, 1.0, 3) for i, v in rows], "vec_id long, embedding array<double>, score double, centre int").repartition(3)
    got = exact_topk.top_scores(frame, collocations.F.col("id") % 10 == 0, k=5, pack_rows=pack_rows)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == _top(rows, 10, 5)


def test_exact_topk_of_few_rows(spark):
    frame = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, -0.25]), (10, [0.0, 0.0])], "vec_id long, embedding array<float>")
    one = collocations.F.col("id") % 10 == 0
    assert sorted(map(tuple, exact_topk.top_scores(frame, one).collect())) == _top([tuple(r) for r in frame.collect()], 10, 5)
    assert exact_topk.top_scores(frame.limit(0), one).count() == 0
    assert exact_topk.top_scores(frame.limit(1), one).count() == 0


def test_pivots_skip_most_of_clustered_vectors():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16)) * 1000
    vectors = np.floor(centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 16)) * 30)
    pivots = exact_topk.choose_pivots(vectors[:500], 32)
    pack = exact_topk.Pack(vectors, pivots)
    queries = vectors[:100]
    query, at = pack.search(queries, np.full(100, -np.inf), 6)
    assert pack.evaluated < 0.25 * 100 * 4000
    whole = queries @ vectors.T
    for q in range(100):
        want = np.sort(whole[q])[-6:]
        assert sorted(whole[q][at[query == q]].tolist())[-6:] == want.tolist()
    bounds = exact_topk.pack_bounds(queries, pivots, pack.table.min(0)[None], pack.table.max(0)[None], np.array([pack.squares.max()]))
    assert (bounds[:, 0] >= whole.max(1)).all()


def test_scores_of_large_numbers_are_exact():
    a, b = np.array([[3e9, 1.0, 7.0]]), np.array([[2e9 + 1, 1.0, 3.0]])
    assert exact_topk.exact_scores(a, b).tolist() == [3 * 10**9 * (2 * 10**9 + 1) + 22]


def test_an_id_has_one_vector_in_the_approximate_search(spark):
    from markwright.llm import ann

    rows = [(0, [1.0, 0.0]), (0, [0.5, 0.5]), (1, [0.9, 0.1]), (1, [0.9, 0.1]), (2, [0.0, 1.0]), (2, [-1.0, 1.0]), (20, [0.3, 0.3])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = [tuple(r) for r in ann.nearest(frame, collocations.F.col("id") % 20 == 0, k=3).orderBy("query_id", "rank").collect()]
    kept = {0: [0.5, 0.5], 1: [0.9, 0.1], 2: [-1.0, 1.0], 20: [0.3, 0.3]}
    want = []
    for q in (0, 20):
        best = sorted((-float(np.dot(kept[q], v)), i) for i, v in kept.items() if i != q)[:3]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    assert [(q, r, i) for q, r, i, _ in got] == [(q, r, i) for q, r, i, _ in want] and np.allclose([g[3] for g in got], [w[3] for w in want])
