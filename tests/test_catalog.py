"""Every query that has SQL against that SQL, on the smallest tables."""

import difflib
import hashlib
import math
import re
import unicodedata
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from markwright.plans.catalog import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(x):
    if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and math.isnan(x)):
        return "NULL"
    return f"{x:.6g}" if isinstance(x, float) else str(x)


def rows(frame):
    frame = frame.reindex(sorted(frame.columns), axis=1)
    return sorted(tuple(map(cell, r)) for r in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    assert len(got)
    if name in ORACLES:
        want = duck.sql(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def _rows(spark, name):
    return QUERIES[name](spark, DATA).collect()


def _table(name):
    return pd.read_parquet(f"{DATA}/{name}.parquet")


def test_sequences_match_as_the_library_says(spark):
    asked = {int(r.conv_id) * 1000 + int(r.turn): r.text for r in _table("conversations").itertuples() if r.role == "user"}
    items = dict(zip(_table("benchmark")["item_id"], _table("benchmark")["text"], strict=True))
    plain = lambda x: re.sub("[^a-z0-9]+", " ", x.lower()).strip()
    got = _rows(spark, "sequence_match")
    assert len(got) == len(asked)
    for r in got:
        a, b = plain(asked[r["id"]]), plain(items[r["item_id"]])
        share = lambda i: len(set(a.split()) & set(plain(items[i]).split())) / len(set(a.split()) | set(plain(items[i]).split()))
        assert round(max(map(share, items)), 4) == round(share(r["item_id"]), 4)
        assert abs(r["sequence"] - (1.0 if a in b or b in a else difflib.SequenceMatcher(None, a, b).ratio())) < 1e-4


def test_line_matches_by_the_library(spark):
    plain = lambda x: re.sub("[^a-z0-9]+", " ", x.lower()).strip()
    of = lambda x, y: difflib.SequenceMatcher(None, x, y).ratio()

    def score(t, c):
        a, b = t.split(), c.split()
        if not a or not b:
            return 0.0
        both, slack = len(set(a) & set(b)), 1 if len(a) <= 3 else max(2, int(len(a) * 0.35))
        windows = [" ".join(b[i : i + n]) for n in range(max(1, len(a) - slack), min(len(b), len(a) + slack) + 1) for i in range(len(b) - n + 1)]
        total = 0.55 * both / len(set(a)) + 0.25 * max([of(t, w) for w in windows], default=0.0) + 0.15 * both / len(set(a) | set(b)) + 0.05 * of(t, c)
        return min(1.0, total + (0.10 if both / len(set(a)) >= 0.75 else 0.0))

    turns = _table("conversations").sort_values(["conv_id", "turn"])
    turns["next"] = turns.groupby("conv_id")["text"].shift(-1)
    asked = {(r.conv_id, r.turn): r for r in turns.itertuples() if r.role == "user" and r.next}
    got = {(r["conv_id"], r["turn"]): (r["line"], r["score"]) for r in _rows(spark, "line_matches")}
    assert got.keys() == {k for k, r in asked.items() if isinstance(r.next, str)}
    for key, (line, value) in list(got.items())[::9]:
        target = plain(re.split(r"[.?!\n]", asked[key].text)[0])
        every = [round(score(target, plain(x)), 4) for x in asked[key].next.split("\n")]
        assert abs(value - max(every)) < 2e-4 and abs(every[line] - value) < 2e-4


def test_disagreements_by_the_library(spark):
    from markwright.plans import papers

    plain = lambda x: " ".join(x.lower().split())
    rows = papers._disagreements(spark, DATA).collect()
    assert len(rows) > 100
    for r in rows[::7]:
        assert abs(r["similarity"] - difflib.SequenceMatcher(None, plain(r["left_text"]), plain(r["right_text"])).ratio()) < 1e-9


def test_repairs_by_the_library(spark):
    from markwright.plans import papers

    plain = lambda x: " ".join(x.lower().split())
    find = lambda p, x: re.search(p, x, re.I)

    def score(texts, i, confidence):
        x = texts[i]
        even = all(x.count(a) == x.count(b) for a, b in ("()", "[]", "{}"))
        symbols = min(1.0, len(re.findall(r"[=+\-/*^_()\[\]{}|]", x)) / max(len(x), 1) * 20 + 0.1 * even + 0.35) if x.strip() else 0.0
        found = {t.lower() for t in re.findall(r"(log|sqrt|sin|cos|tan|[A-Za-z]\^\d+|[A-Za-z]_\d+|\d+[A-Za-z]|[A-Za-z]+\d+)", x)}
        math_ = (min(1.0, 0.4 + len(found) / 10) if found else 0.5) if x.strip() else 0.0
        q, a = find(r"(^|\n)\s*(q[.)]|question[:.]?)", x), find(r"(^|\n)\s*(a[.)]|answer[:.]?)", x)
        anchors = 1.0 if q and a else 0.75 if q or a else 0.55 if find("solve|find|prove|show that|explain|state", x) else 0.3
        peers = [t for k, t in enumerate(texts) if k != i and t.strip()]
        agree = sum(difflib.SequenceMatcher(None, plain(x), plain(t)).ratio() for t in peers) / len(peers) if peers else 0.5
        return round(max(0.0, min(1.0, 0.38 * confidence + 0.2 * symbols + 0.18 * math_ + 0.12 * anchors + 0.12 * agree)), 4)

    pages = {}
    for r in papers._readings(spark, DATA).orderBy("page", "at").collect():
        pages.setdefault(r["page"], []).append((r["text"], r["confidence"]))
    got = {r["page"]: r for r in _rows(spark, "repaired_best_readings")}
    assert got.keys() == pages.keys() and 0 < sum(r["accepted"] for r in got.values()) < len(got)
    for page, readings in list(pages.items())[::3]:
        texts, sure = [t for t, _ in readings], [c for _, c in readings]
        scores = [score(texts, i, sure[i]) for i in range(3)]
        best = max(range(3), key=lambda i: (scores[i], sure[i], -i))
        new = texts[0] + " Answer: log x = [2]" if page % 2 == 0 else texts[0][: len(texts[0]) // 2]
        again = [new if i == best else t for i, t in enumerate(texts)]
        after = [score(again, i, sure[i]) for i in range(3)]
        leads = all((after[best], sure[best]) >= (after[i], sure[i]) for i in range(3))
        r = got[page]
        assert abs(r["before"] - scores[best]) < 2e-4 and abs(r["after"] - after[best]) < 2e-4, page
        if abs(after[best] - scores[best]) > 3e-4 and all(abs(after[best] - after[i]) > 3e-4 for i in range(3) if i != best):
            assert r["accepted"] == (leads and after[best] >= scores[best])
            assert r["text_md5"] == hashlib.md5((new if r["accepted"] else texts[best]).encode()).hexdigest()


def test_prose_runs_by_hand(spark):
    def run(lines):
        best = cur = 0
        gap = False
        for n in (len(x.split()) for x in lines):
            if n >= 4 or cur and not gap and 1 <= n <= 2:
                cur, gap = cur + n, n < 4
                best = max(best, cur)
            else:
                cur, gap = 0, False
        return best

    want = {r.doc_id: run(r.text.split("\n")) for r in _table("documents").itertuples()}
    assert {r["doc_id"]: r["words"] for r in _rows(spark, "prose_runs")} == want


def test_text_repair_by_hand(spark):
    def one(x):
        bad = lambda s: sum(map(s.count, "âÂÃ"))
        try:
            again = x.encode("cp1252").decode("utf-8") if bad(x) else x
        except (UnicodeEncodeError, UnicodeDecodeError):
            again = x
        x = again if bad(again) < bad(x) else x
        x = unicodedata.normalize("NFKC", x).translate(str.maketrans("‘’“”", "''\"\""))
        return hashlib.md5(re.sub(r"\s+([,.;:!?])", r"\1", " ".join(x.split())).encode()).hexdigest()

    assert {r["doc_id"]: r["tidy_md5"] for r in _rows(spark, "text_repair")} == {r.doc_id: one(r.text) for r in _table("documents").itertuples()}


def test_options_and_confusions_by_hand(spark):
    pairs = {frozenset(p) for p in ("bk", "ao", "i1", "l1", "0o", "s5", "gq", "uv", "ce", "tf", "aq", "pg", "ji", "f7")}

    def confused(x, y):
        unlike = [(a, b) for a, b in zip(x, y, strict=False) if a != b]
        return len(x) == len(y) and len(unlike) == 1 and frozenset(unlike[0]) in pairs

    words = {r.doc_id: re.sub("[^a-z0-9]+", " ", r.text.lower().translate(str.maketrans("–−", "--"))).split() for r in _table("documents").itertuples()}
    change = [lambda w: re.sub("[ae]", "o", w), lambda w: w.replace("u", "v"), lambda w: w + "x"]
    got = {r["doc_id"]: (r["confused"], r["n"]) for r in _rows(spark, "visual_confusions")}
    assert got == {i: (sum(confused(x, change[k % 3](x)) for k, x in enumerate(w)), len(w)) for i, w in words.items() if w}
    options = {r["doc_id"]: r["options"] for r in _rows(spark, "inline_options")}
    plain = lambda w: [*w, *["none"] * 4][:4]
    clear = {i: ";".join(f"{a}={b}" for a, b in zip("ABCD", plain(w), strict=True)) for i, w in words.items() if not {"a", "b", "c", "d"} & set(plain(w))}
    assert {i: options[i] for i in clear} == clear
