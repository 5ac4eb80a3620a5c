"""Dedup of repeated passages, decontamination, lines and the n-gram join against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from markwright.llm import anchors, decontaminate, line_dedup, ngram_join, substring_dedup, suffix_dedup
from markwright.llm.anchors import Finder
from markwright.llm.common import mix64

SCHEMA = "doc_id long, text string, spans string, n_words long"  # two columns clash with results or inner names


def texts():
    rng = random.Random(5)
    vocabulary = ["w%d" % i for i in range(60)] + ["é", "ß,", "the", "of"]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    shared, other = prose(70), prose(45)
    rows = [
        (1, prose(50) + " " + shared + " " + prose(30)),
        (2, shared),
        (3, "x " + shared[3:] + " y\n" + other),
        (4, None),
        (5, ""),
        (6, "short text"),
        (7, other + "\t" + prose(5) + "\n\n" + other),
        (8, "Is onhe. " * 120),
        (9, "Is onhe. " * 60),
        (10, shared + " " + other),
        (None, other + " end"),
        (11, prose(400)),
        (12, " \n\t "),
        (2, shared),
        (13, "ab" * 200 + "c" + "ab" * 80),
    ]
    return [(i, t, "clash", 1) for i, t in rows]


def frame(spark, rows=None):
    frame = spark.createDataFrame(texts() if rows is None else rows, SCHEMA).repartition(3)
    for name in ("_doc", "_key", "_spans", "_starts", "_gone", "_marks", "_items", "_text", "key", "at", "h1", "starts", "bucket"):
        frame = frame.withColumn(name, F.lit("clash"))  # names that an operator may use inside
    return frame


def distinct(rows):
    """Rows of equal id and text are one document; null ids come first."""
    return sorted({(i, t or "") for i, t, *_ in rows}, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


#: pieces shorter than most texts, and tasks that pass on anchors all the time
SMALL = {"buffer": 250, "flush": 40}


@pytest.mark.parametrize("length,gram,options", [(100, 32, {}), (20, 8, {}), (100, 32, SMALL), (20, 8, SMALL), (20, 8, {"buffer": 33, "flush": 1})])
def test_suffix_dedup(spark, length, gram, options):
    rows = texts()
    got = {(r["doc_id"], r["text"] or ""): r for r in suffix_dedup.dedup(frame(spark), length, gram, **options).collect()}
    seen = set()
    for i, t in distinct(rows):
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for at in range(len(b) - length + 1):
            piece = b[at : at + length]
            if piece in seen:
                gone[at : at + length] = True
            seen.add(piece)
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        r = got[(i, t)]
        runs = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()), (i, t[:50])
        assert bytes(r["kept"]) == kept and r["spans"] == "clash"


@pytest.mark.parametrize("length,gram,options", [(35, 10, {}), (8, 3, {}), (35, 10, {"buffer": 60, "flush": 10}), (8, 3, {"buffer": 13, "flush": 1})])
def test_substring_dedup(spark, length, gram, options):
    rows = texts()
    got = {(r["doc_id"], r["text"] or ""): r for r in substring_dedup.dedup(frame(spark), length, gram, **options).collect()}
    docs = [(i, t, t.split()) for i, t in distinct(rows)]
    counts = {}
    for _, _, w in docs:
        for at in range(len(w) - length + 1):
            counts[tuple(w[at : at + length])] = counts.get(tuple(w[at : at + length]), 0) + 1
    for i, t, w in docs:
        gone = set()
        for at in range(len(w) - length + 1):
            if counts[tuple(w[at : at + length])] > 1:
                gone.update(range(at, at + length))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        r = got[(i, t)]
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()), (i, t[:50])


def test_passage_over_the_edge_of_a_piece(spark):
    rng = np.random.default_rng(8)
    words = [f"{x:x}" for x in rng.integers(1 << 24, 1 << 28, 1 << 19).tolist()]  # 7 letters, with the space 8
    text = " ".join(words)[: (1 << 21) + 4000]
    rows = [(1, text)] + [(200 + k, text[(1 << 21) + 110 - 400 + k : (1 << 21) + 110 + k]) for k in range(-90, 91, 20)]
    got = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), with_text=False).collect()}
    assert got == {i: 0 if i == 1 else len(t) for i, t in rows}
    many = [f"{x:x}" for x in rng.integers(0, 1 << 28, (1 << 21) + 500).tolist()]
    at = (1 << 21) - 40
    rows = [(1, " ".join(many)), (2, " ".join(many[at : at + 60])), (3, " ".join(many[:60]))]
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), with_text=False).collect()}
    assert got == {1: 120, 2: 60, 3: 60}


def test_index_that_refutes_a_class():
    need = np.zeros(4, anchors.NEED)
    need["h"], need["ctx"], need["back"], need["pair"] = [1, 1, 1, 2], [5, 5, 6, 5], 3, [1, 1, 0, 0]
    plan, pairs = suffix_dedup.plan(), anchors._pairs(need)
    assert [x.tolist() for x in pairs] == [[0], [1]]
    assert not anchors._refuted(plan, need, pairs, np.array([0, 4, 1, 0]))
    assert anchors._refuted(plan, need, pairs, np.array([0, 3, 1, 0])) and anchors._refuted(substring_dedup.plan(), need, pairs, np.array([0, 4, 1, 0]))
    need["back"][1] = 2
    assert anchors._pairs(need) is None


def test_start_over_with_other_hashes(spark, monkeypatch):
    plain = {(r["doc_id"], r["text"]): r["n_removed"] for r in suffix_dedup.dedup(frame(spark), 20, 8).collect()}
    first = anchors.spans_by_doc
    monkeypatch.setattr(anchors, "spans_by_doc", lambda docs, plan, scratch: first(docs, plan, scratch, 3))
    assert {(r["doc_id"], r["text"]): r["n_removed"] for r in suffix_dedup.dedup(frame(spark), 20, 8).collect()} == plain


def test_multikey_quicksort():
    rng = np.random.default_rng(5)
    words, group = rng.integers(0, 3, (500, 4)).astype(np.uint64), rng.integers(0, 5, 500)
    order, opens = suffix_dedup.shallow_sort(words, group)
    rows = [(group[i], *words[i].tolist()) for i in order]
    assert rows == sorted(rows) and opens.tolist() == [k == 0 or rows[k] != rows[k - 1] for k in range(500)]
    assert len(suffix_dedup.shallow_sort(words[:0], group[:0])[0]) == 0


def test_bit_vector():
    bits = (np.random.default_rng(1).random(5000) < 0.3).astype(np.uint8)
    at = np.arange(5001)
    assert (substring_dedup.BitVector(bits).rank(at) == np.concatenate([[0], np.cumsum(bits)])).all()


def test_windows_share_anchors():
    rng = np.random.default_rng(3)
    symbols = mix64(rng.integers(0, 4, 3000).astype(np.uint64))
    runs = Finder(30, 8).find(symbols, np.array([0, 1000]), np.array([1000, 2000]))
    starts = np.concatenate([np.arange(a, b + 1) for a, b in zip(runs["low"], runs["high"], strict=True)])
    assert starts.tolist() == [*range(971), *range(1000, 2971)]  # each window start once, none over the edge
    assert (runs["at"] >= runs["high"]).all() and (runs["at"] + 8 <= runs["low"] + 30).all()


def test_blind_trie_sorts():
    rng = random.Random(1)
    strings = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 12))).encode() for _ in range(200)]
    order, common = suffix_dedup.BlindTrie(strings).walk()
    assert [strings[i] for i in order] == sorted(strings)
    for k in range(1, len(order)):
        a, b = strings[order[k - 1]], strings[order[k]]
        n = next((j for j in range(min(len(a), len(b))) if a[j] != b[j]), min(len(a), len(b)))
        assert common[k] == n


def test_matching_statistics():
    rng = np.random.default_rng(2)
    sizes = np.array([9, 14, 6, 20])
    n, words = len(sizes), rng.integers(0, 3, sizes.sum())
    text, ends = np.empty(sizes.sum() + n, np.int64), np.cumsum(sizes + 1) - 1
    inside = np.ones(len(text), bool)
    inside[ends] = False
    text[inside], text[ends] = words + n, np.arange(n)
    begins = ends - sizes
    got, low, high = substring_dedup.matching_statistics(substring_dedup.FMIndex(text, 30), text, begins, sizes)
    parts = [tuple(text[b : b + s]) for b, s in zip(begins, sizes, strict=True)]
    count = lambda p: sum(q[i : i + len(p)] == p for q in parts for i in range(len(q) - len(p) + 1))
    for b, part in zip(begins, parts, strict=True):
        for i in range(len(part)):
            longest = max((m for m in range(1, len(part) - i + 1) if count(part[i : i + m]) >= 2), default=0)
            assert got[b + i] == longest and (not longest or high[b + i] - low[b + i] == count(part[i : i + longest]))


def test_nearest_smaller_values():
    values = np.random.default_rng(3).integers(0, 5, 300)
    values[0] = -1
    want = [max((j for j in range(i) if values[j] < values[i]), default=0) for i in range(300)]
    assert substring_dedup._smaller_before(values).tolist() == want


def test_decontamination(spark):
    rng = random.Random(9)
    words = ["alpha", "Beta", "gämma", "d4", "epsilon"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(1, prose(14)), (2, "tiny item"), (3, None), (4, "..."), (None, prose(12)), (22, "tiny item"), (5, prose(10))]
    rows = [(1, "A " + items[0][1].upper() + " b"), (2, "Tiny, ITEM!"), (3, None), (4, ""), (5, prose(300)), (6, items[4][1]), (5, prose(300)), (7, "x".join(items[6][1].split(" ")))]
    rows = [(i, t, "clash", 1) for i, t in rows]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cut = lambda s: pattern.findall(re.sub("[A-Z]", lambda m: m[0].lower(), s or ""))
    windows = {}
    for i, t in items:
        w = cut(t)
        m = min(10, len(w))
        for k in range(len(w) - m + 1 if m else 0):
            windows.setdefault(tuple(w[k : k + m]), set()).add(i)
    want = []
    for i, t, *_ in rows:
        w, hit, found = cut(t), set(), set()
        for m in {len(p) for p in windows}:
            for k in range(len(w) - m + 1):
                if (ids := windows.get(tuple(w[k : k + m]))) is not None:
                    hit.update(range(k, k + m))
                    found |= ids
        ids = sorted(str(x) for x in found if x is not None)
        want.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    for options in ({}, {"block_bytes": 40}, {"limit": 5000}):  # one block, and several
        got = decontaminate.decontaminate(frame(spark, rows), benchmark, **options)
        assert "spans" in got.columns
        assert sorted(map(tuple, got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect())) == sorted(want)


def test_tables_of_patterns_stay_sparse():
    rng = np.random.default_rng(3)
    items = [(str(k), " ".join(f"w{x}" for x in rng.integers(0, 3000, 60)).encode()) for k in range(800)]
    found = decontaminate.matchers(items, 10)
    assert len(found) == 1 and all((g.shift == 0).mean() < 0.1 for g in found[0].groups)
    hit, ids = found[0].scan([b"x " + items[5][1] + b" y", items[7][1][:20]])[0]
    assert hit.sum() == 60 and ids == {"5"}
    halves = decontaminate.matchers(items, 10, found[0].nbytes() // 3)
    assert len(halves) >= 3 and sorted(i for m in halves for i in m.ids) == sorted(i for i, _ in items)


def test_lines(spark):
    rows = [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc"), (3, "a\nb"), (4, None), (5, ""), (6, "a\nb\nc\na\nb\nc\nd"), (7, "b\nc\nd\nb\nc\nd"), (None, "q\na\nb\nc"), (1, "a\nb\nc\nd"), (8, "\n".join(f"l{i}" for i in range(3000))), (9, "\n".join(f"l{i}" for i in range(1, 3000, 1)))]
    rows = [(i, t, "clash", 1) for i, t in rows]
    got = {(r["doc_id"], r["text"]): (r["n_lines"], r["n_removed"], r["kept_text"]) for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    seen = set()
    for i, t in sorted({(i, t) for i, t, *_ in rows}, key=lambda r: (r[0] is not None, r[0] or 0)):
        lines, gone = [] if t is None else t.split("\n"), set()
        for k in range(len(lines) - 2):
            w = tuple(lines[k : k + 3])
            if w in seen:
                gone.update((k, k + 1, k + 2))
            seen.add(w)
        kept = None if t is None else "\n".join(x for k, x in enumerate(lines) if k not in gone)
        assert got[(i, t)] == (len(lines), len(gone), kept), (i, t)


def test_lines_stay_native(spark, capsys):
    line_dedup.dedup_lines(frame(spark)).explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)


@pytest.mark.parametrize("size,num,den", [(4, 85, 100), (5, 80, 100), (2, 50, 100)])
def test_ngram_components(spark, size, num, den):
    rng = random.Random(size)
    vocabulary = ["w%d" % i for i in range(80)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    rows, passage = [], prose(25)
    for f in range(6):
        base = prose(rng.randint(20, 90))
        for _ in range(9):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append(w)
    rows += [passage + prose(12) for _ in range(25)] + [prose(3), prose(2), ["one"], ["One"]]
    docs = [(100 - k, " ".join(w).upper() if k % 3 else " ".join(w), "clash", 1) for k, w in enumerate(rows)]
    docs += [(900, None, "c", 1), (901, " \n", "c", 1), (902, "", "c", 1), (None, docs[0][1], "c", 1)]

    def shingles(t):
        w = (t or "").lower().split()
        k = min(size, len(w))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()

    sets = {i: shingles(t) for i, t, *_ in docs if i is not None}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = ngram_join.ngram_components(frame(spark, docs), size, num, den).collect()
    assert len(got) == len(docs)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["n_shingles"] == len(shingles(docs[0][1]))
        else:
            assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), find(r["doc_id"])), r


def test_ngram_components_of_repeated_ids(spark):
    text = lambda k: " ".join(f"{k}{i}" for i in range(40))
    rows = [(5, text("a")), (5, text("b")), (3, text("b")), (7, text("a") + " x"), (9, text("c")), (9, text("c")), (None, text("c")), (2, None), (2, "d")]
    got = ngram_join.ngram_components(frame(spark, [(i, t, "c", 1) for i, t in rows])).collect()
    want = [(5, 36, 5), (5, 36, 3), (3, 36, 3), (7, 37, 5), (9, 36, 9), (9, 36, 9), (None, 36, None), (2, 0, 2), (2, 1, 2)]
    assert sorted(map(str, ((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got))) == sorted(map(str, want))


@pytest.mark.parametrize("work", ["suffix", "substring", "lines", "ngrams", "decontaminate"])
def test_empty_tables(spark, work):
    none = spark.createDataFrame([], SCHEMA)
    got = {
        "suffix": lambda: suffix_dedup.dedup(none),
        "substring": lambda: substring_dedup.dedup(none),
        "lines": lambda: line_dedup.dedup_lines(none),
        "ngrams": lambda: ngram_join.ngram_components(none),
        "decontaminate": lambda: decontaminate.decontaminate(none, spark.createDataFrame([], "item_id long, text string")),
    }[work]()
    assert got.count() == 0


def test_empty_benchmark(spark):
    got = decontaminate.decontaminate(frame(spark), spark.createDataFrame([], "item_id long, text string"))
    assert got.agg(F.sum("n_hit")).first()[0] == 0
