"""Best items of a text and items in a text, against brute force."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from markwright.functions import text as tx
from markwright.operators import matching, wordindex

WORDS = [f"w{i}" for i in range(300)]


def _bag(rng, n):
    return [WORDS[i] for i in rng.zipf(1.2, n) % len(WORDS)]


def _brute(index_rows, words, k, by, larger):
    words = set(words)
    scored = []
    for i, own in index_rows:
        shared = len(words & set(own))
        if shared:
            score = shared / len(words) if by == "overlap" else np.floor(shared / len(words | set(own)) * 10_000 + 0.5) / 10_000
            scored.append((-score, -i if larger else i, shared))
    return [(abs(i), s) for _, i, s in sorted(scored)[:k]]


@pytest.mark.parametrize("by", ["overlap", "jaccard"])
@pytest.mark.parametrize("larger", [False, True])
@pytest.mark.parametrize("few", [0, 1 << 14])
def test_best_items_are_those_of_scoring_all(monkeypatch, by, larger, few):
    monkeypatch.setattr(wordindex, "FEW", few)
    rng = np.random.default_rng(1)
    rows = [(i, _bag(rng, int(rng.integers(1, 30)))) for i in range(1, 400)] + [(1000, []), (1001, ["w1"]), (1002, ["w1"])]
    index = wordindex.ItemIndex([(i, [w.encode() for w in own]) for i, own in rows])
    for n in (0, 1, 3, 20, 100):
        for k in (1, 5, 600):
            words = _bag(rng, n) + ["unknown"]
            found, shared = index.best({w.encode() for w in words}, k, by, larger)
            assert list(zip(index.ids[found].tolist(), shared.tolist(), strict=True)) == _brute(rows, words, k, by, larger)
    assert not index.count.any() and not index.held.any()


def test_lists_of_frequent_words_stay_closed(monkeypatch):
    monkeypatch.setattr(wordindex, "FEW", 0)
    rows = [(i, [b"the", b"of", b"rare%d" % (i // 4), b"x%d" % i]) for i in range(10_000)]
    index = wordindex.ItemIndex(rows)
    found, shared = index.best({b"the", b"of", b"rare7", b"x29", b"none"}, 1, "overlap")
    assert index.ids[found].tolist() == [29] and shared.tolist() == [4]
    assert index.touched < 10_100  # of two long lists one: items of both would tie
    index.touched = 0
    found, shared = index.best({b"rare7", b"x28", b"x29", b"x30", b"x31", b"of", b"the"}, 2, "jaccard")
    assert index.ids[found].tolist() == [28, 29]
    long = {b"the", b"of"} | {b"rare%d" % i for i in range(40)} | {b"x%d" % i for i in range(160)}
    index.touched = 0
    found, shared = index.best(long, 3, "overlap")
    assert shared.tolist() == [4, 4, 4] and index.touched < 12_000  # one of the two long lists: items of both would tie


@pytest.mark.parametrize("few", [0, 1 << 14])
def test_items_that_reach_a_score(monkeypatch, few):
    monkeypatch.setattr(wordindex, "FEW", few)
    rng = np.random.default_rng(2)
    rows = [(i, _bag(rng, int(rng.integers(1, 30)))) for i in range(300)]
    index = wordindex.ItemIndex([(i, [w.encode() for w in own]) for i, own in rows])
    for _ in range(60):
        words, least = set(_bag(rng, 25)), rng.random(300) * 0.4 * (rng.random(300) < 0.9)
        found, shared = index.reaching({w.encode() for w in words}, least)
        got = dict(zip(index.ids[found].tolist(), shared.tolist(), strict=True))
        for j, (i, own) in enumerate(rows):
            both = len(words & set(own))
            if both and np.floor(both / len(words | set(own)) * 10_000 + 0.5) / 10_000 >= least[j]:
                assert got[i] == both


def test_automaton_finds_what_containment_finds():
    rng = np.random.default_rng(3)
    letters = [b"a", b"b", b"c", b"d"]
    for _ in range(200):
        draw = lambda n: [letters[i] for i in rng.integers(0, 4, n)]
        rows = [(i, draw(int(rng.integers(0, 5)))) for i in range(12)] + [(12, [b"a"]), (13, [b"a"])]
        text = draw(int(rng.integers(0, 40))) + [b"e"] * 3 + draw(5)
        body = b" " + b" ".join(text) + b" "
        assert wordindex.WordAutomaton(rows).items_in(text) == {i for i, own in rows if own and b" " + b" ".join(own) + b" " in body}


def test_words_are_those_of_the_expression(spark):
    texts = ["The  CAT's x₂ + y² – log₁₀ “ok” é É K İ ß 日本 a·b", None, "", "...", "tab\there\nnew", "5×3→6 ﹣1"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["w"] for r in frame.select("i", tx.tokens(F.col("t")).alias("w")).collect()}
    assert got == {i: [w.decode() for w in wordindex.words_of(t)] for i, t in enumerate(texts)}


def test_bank_in_blocks_and_texts_where_they_are(spark, monkeypatch):
    rng = np.random.default_rng(4)
    items = spark.createDataFrame([(i, " ".join(_bag(rng, 6))) for i in range(60)] + [(60, "w1"), (61, ""), (62, None), (None, "w2")], "i long, text string")
    docs = spark.createDataFrame([(i, " ".join(_bag(rng, 40))) for i in range(80)] + [(80, None), (81, "")], "d long, text string")
    plain = lambda x: " " + re.sub("[^a-z0-9]+", " ", (x or "").lower()).strip() + " "
    want = {(q["i"], r["d"]) for q in items.collect() for r in docs.collect() if q["i"] is not None and plain(q["text"]).strip() and plain(q["text"]) in plain(r["text"])}
    once = {}
    for size in (2_000_000, 20):
        monkeypatch.setattr(matching, "INDEX_WORDS", size)
        hits = matching.exact_hits(docs, items, "i", "d")
        assert {(r["q"], r["r"]) for r in hits.collect()} == want and any(q == 60 for q, _ in want)
        near = matching.ranked_docs(docs, items, "i", "d", 3)
        once.setdefault("near", sorted(map(tuple, near.collect())))
        assert sorted(map(tuple, near.collect())) == once["near"]
        best = matching.best_jaccard(docs, items, "d", "i")
        once.setdefault("best", sorted(map(tuple, best.collect())))
        assert sorted(map(tuple, best.collect())) == once["best"] and len(once["best"]) == 80
        if size > 20:
            assert "Exchange" not in hits._jdf.queryExecution().executedPlan().toString()  # no text is shuffled
