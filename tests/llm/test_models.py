"""Language ID, HTML extraction, nearest neighbours, mixing, token output and the pipeline."""

import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from markwright.llm import ann, common, html_extract, langid, mixing, token_output

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_language_id_on_held_out_rows(spark, documents):
    held_out = F.col("doc_id") % 4 == 2
    model = langid.train(documents, ~held_out)
    got = langid.identify(documents, model).where(held_out).select("lang", "lang_pred", "score", "rejected").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.95 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got) and sum(r["rejected"] for r in got) <= 0.05 * len(got)
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "123 -- !!", "x"), (4, "le la des " * 20000, "x"), (4, "le la des " * 20000, "x")], "doc_id long, text string, score string")
    rows = sorted(langid.identify(odd, model).collect(), key=lambda r: r["doc_id"])
    assert [(r["lang_pred"], r["score"], r["rejected"]) for r in rows[:3]] == [("und", 0.0, True)] * 3
    assert rows[3] == rows[4] and rows[3]["lang_pred"] in model.languages


def test_language_id_without_labels(spark):
    rows = spark.createDataFrame([(1, "some words", None)], "doc_id long, text string, lang string")
    model = langid.train(rows, F.lit(True))
    assert langid.identify(rows, model).first()["lang_pred"] == "und"
    assert langid.identify(rows.limit(0), model).count() == 0


def _two_scripts():
    rng = np.random.default_rng(3)
    def text(letters, breaks):
        return "".join(letters[i] + ("." if b else "") for i, b in zip(rng.integers(0, len(letters), 300), rng.random(300) < breaks, strict=True))
    left, right = "日本語文章言葉世界学校時間", "คนไทยภาษากลาง"
    return text, left, right, langid.fit([(text(left, 0.02), "aa") for _ in range(30)] + [(text(right, 0.02), "bb") for _ in range(30)])


def test_language_of_a_long_run_is_that_of_the_whole_run(monkeypatch):
    text, left, right, model = _two_scripts()
    runs = [left[:10] * 3 + text(right, 0) * 5, right[:8] * 3 + text(left, 0) * 5]
    assert langid.predict(model, runs)[0] == ["bb", "aa"]
    same = [left * 13, left * 10 + right * 40]
    assert langid.predict(model, same)[0] == ["aa", "bb"]
    words = runs + same + ["a", "日本", "b" * 700]
    ids, starts = langid.subwords(words)
    for size in (7, 64, 1000):
        for word, want in zip(words, np.split(ids, starts[1:]), strict=True):
            assert sorted(np.concatenate(list(langid.long_subwords(word, size))).tolist()) == sorted(want.tolist())
    want = langid.predict(model, words)
    monkeypatch.setattr(langid, "BYTES_AT_ONCE", 50)
    monkeypatch.setattr(langid.WordLogits, "LETTERS_LIMIT", 100)
    got = langid.predict(model, words)
    assert got[0] == want[0] and np.allclose(got[1], want[1])


@pytest.mark.parametrize("learned", [1, 2, 4])
def test_language_id_rejects_what_it_has_not_learned(spark, learned):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r["text"], r["lang"]) for r in documents.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang").collect())
    names = sorted({lang for _, lang in rows})[:learned]
    mine = [r for r in rows if r[1] in names]
    model = langid.fit([r for k, r in enumerate(mine) if k % 4 != 2])
    rejects = lambda texts: [lang == "und" or model.rejects(*rest) for lang, *rest in langid.judge(model, texts)]
    clean = rejects([text for k, (text, _) in enumerate(mine) if k % 4 == 2])
    assert sum(clean) <= 0.05 * len(clean)
    rng = np.random.default_rng(1)
    junk = [" ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7)) for _ in range(40)) for _ in range(50)]
    assert sum(rejects(junk)) >= 45
    other = ["Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.", "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto."]
    other += [text for text, lang in rows if lang not in names and len(text.split()) >= 40][:50]
    assert sum(rejects(other)) >= 0.9 * len(other)


def test_html_blocks():
    page = "<html><head><title>t</title></head><body><p>a &amp; b<br>c<p><b>d</b> e&nbsp;f<script>x('</p>')</script><ul><li>g<li>h</ul><!-- <p>no</p> -->"
    assert [b.text for b in html_extract.blocks(page)] == ["a & b c", "d e f", "g", "h"]
    assert html_extract.blocks(None) == [] and html_extract.blocks("<p>open <b") != []


@pytest.mark.parametrize(
    "page, want",
    [
        ("<p>a</p><svg width='1'/><p>b</p><math/><p>c</p>", ["a", "b", "c"]),
        ("<p>a</p><noscript><p>b</p><object><p>c</p>", ["a", "b", "c"]),
        ("<svg-icon><p>a</p></svg-icon><p>b</p><title-block>c</title-block><script-x>d</script-x>", ["a", "b", "c", "d"]),
        ("<p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be <svg><g><path d='M0'/></g></svg>so</p><object data=x>d</object>", ["Let x=1 be so", "d"]),
        ("<p>a<svg><path d='M0'/><p>b<template><p>c</p></template>", ["a", "b", "c"]),
        ("<p>a</p><script src='x'/><p>b</p><script src=x/>no</script><p>c</p><style>no", ["a", "b", "c"]),
        ("<p>a</p><TEXTAREA>no <p>no</p></textarea ><iframe>no</iframe><title>no</title>b", ["a", "b"]),
    ],
)
def test_html_drops_raw_text_only(page, want):
    assert [b.text for b in html_extract.blocks(page)] == want


@pytest.mark.parametrize(
    "page, want",
    [
        ("<html><head><title>t</title><article><p>text", ["text"]),
        ("<head><meta charset=x><link rel=y><style>s</style><a href=z>text</a> more", ["text more"]),
        ("<head><title>t</title>text", ["text"]),
        ("<head><noscript>no</noscript><template><p>no</p></template><script>no</script></head><p>text", ["text"]),
        ("<head><template><p>text", ["text"]),
    ],
)
def test_html_head_that_is_left_open(page, want):
    assert [b.text for b in html_extract.blocks(page)] == want


def test_html_scans_in_linear_time():
    import time

    cut = "<p>a</p><a " + 'b="c" ' * 200
    for page in (cut, "<p>a</p>" + "<a " * 100_000, "<p>a</p>" + '<a b="' * 100_000 + ">", "<p>a</p>" + "<!" * 100_000, "<p>a</p><x " + "= " * 100_000, "<p>a</p>" + "<b c='d' " * 50_000 + "<p>"):
        began = time.perf_counter()
        assert html_extract.blocks(page)[0].text == "a"
        assert time.perf_counter() - began < 1
    began = time.perf_counter()
    html_extract.blocks(cut)
    assert time.perf_counter() - began < 0.01


@pytest.mark.parametrize(
    "page, want",
    [
        ("<p title='a>b'>c</p>", ["c"]),
        ('<p title="a>b>c</p><p>d</p>', ["b>c", "d"]),
        ("<p>1 < 2 and 3 > 2</p><!-- <p>no</p> --><p>b<!-- no", ["1 < 2 and 3 > 2", "b"]),
        ("<P CLASS=x>a<BR/>b</P><!DOCTYPE x><?php y ?>c", ["a b", "c"]),
    ],
)
def test_html_tags(page, want):
    assert [b.text for b in html_extract.blocks(page)] == want


def test_html_depth_has_no_cap():
    page = "<nav class=menu>" + "<div>" * 300 + "<section>" + "<span><div>" * 700 + "<p>deep</p>" + "</div>" * 700 + "</section><p>mid</p>" + "</div>" * 300 + "</nav><p>out</p>"
    deep, mid, out = html_extract.blocks(page)
    assert deep.tags == {"nav", "div", "section", "p"} and mid.tags == {"nav", "div", "p"} and out.tags == {"p"} and not out.hints
    unclosed = html_extract.blocks("<article>" + "".join(f"<x-{i}>" for i in range(20000)) + "<p>a</p></article><p>b</p>")
    assert [(b.text, set(b.tags)) for b in unclosed] == [("a", {"article", "p"}), ("b", {"p"})]


def test_html_held_out_pages():
    crf = html_extract.trained()
    wrong = total = 0
    for rows, labels in html_extract.labelled(html_extract.training_pages(80, seed=77)):
        got = crf.decode(rows)
        wrong += sum(a != b for a, b in zip(got, labels, strict=True))
        total += len(labels)
    assert wrong <= 0.02 * total


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_html_of_the_given_pages(size):
    """The article of each given page, read by another parser: what stands in <article>, a block for each h1 and p."""
    import pyarrow.parquet as pq

    class Article(HTMLParser):
        def __init__(self):
            super().__init__()
            self.inside, self.blocks, self.parts = False, [], []

        def cut(self):
            text = " ".join("".join(self.parts).split())
            self.blocks += [text] if text else []
            self.parts = []

        def handle_starttag(self, tag, attrs):
            self.inside |= tag == "article"
            self.parts.append(" ") if tag == "br" else self.cut() if tag != "b" else None

        def handle_endtag(self, tag):
            self.cut() if tag != "b" else None
            self.inside &= tag != "article"

        def handle_data(self, data):
            self.parts += [data] if self.inside else []

    crf = html_extract.trained()
    for r in pq.read_table(f"/root/testdata/{size}/pages.parquet").to_pylist():
        page = Article()
        page.feed(r["html"])
        page.close()
        page.cut()
        assert html_extract.extract_text(r["html"], crf) == "\n".join(page.blocks), r["page_id"]


def test_html_extract(spark):
    body = "<article><h1>Title here</h1><p>Some   long text, with words.</p></article>"
    page = f"<body><nav><ul><li><a href='/'>Home</a></li></ul></nav>{body}<div class='ad'>Buy now</div><footer>&copy; site</footer></body>"
    rows = spark.createDataFrame([(1, "u", page, "t"), (2, None, None, "t"), (3, "u", "", "t"), (1, "u", page, "t")], "page_id long, url string, html string, text string")
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in html_extract.extract(rows).collect())
    want = "Title here\nSome long text, with words."
    assert got == [(1, want, len(want))] * 2 + [(2, "", 0), (3, "", 0)]
    assert html_extract.extract(rows.limit(0)).count() == 0


def test_crf_viterbi_is_the_best_path():
    crf, rng = html_extract.Crf(), np.random.default_rng(0)
    crf.emit, crf.move, crf.bias = rng.normal(size=crf.emit.shape), rng.normal(size=(2, 2)), 0.1
    rows = [rng.integers(0, len(crf.emit), 3).tolist() for _ in range(7)]
    e = crf.scores(rows)
    score = lambda p: sum(e[k] * s for k, s in enumerate(p)) + sum(crf.move[a, b] for a, b in zip(p[:-1], p[1:], strict=True))
    best = max(([(i >> k) & 1 for k in range(7)] for i in range(128)), key=score)
    assert crf.decode(rows) == best


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(700, 12)) * rng.uniform(0.5, 2, (700, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(1000 + i, vectors[7].tolist()) for i in range(60)]
    rows += [(2000, None), (2020, [0.0] * 12), (2040, [float("nan")] * 12), (2060, [1.0]), (None, vectors[0].tolist()), (2080, [None] + [1.0] * 11)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = ann.nearest(docs, F.col("id") % 20 == 0, k=20, pack_rows=200).collect()
    ids = np.array([i for i, v in rows if i is not None and v is not None and len(v) == 12 and None not in v and np.isfinite(v).all() and any(v)])
    table = np.array([v for i, v in rows if i in set(ids.tolist()) and v is not None])
    found = hits = 0
    for q in ids[ids % 20 == 0]:
        s = (table * table[ids == q][0]).sum(1)
        order = [int(i) for i in ids[np.lexsort((ids, -np.round(s, 10)))] if i != q][:20]
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 21))
        for r in mine:
            assert abs(r["score"] - s[ids == r["vec_id"]][0]) < 1e-9
        hits += len(set(order) & {r["vec_id"] for r in mine})
        found += 20
    assert hits >= 0.95 * found
    assert {r["query_id"] for r in got} == set(ids[ids % 20 == 0].tolist())
    assert ann.nearest(docs.limit(0), F.col("id") % 20 == 0).count() == 0
    few = ann.nearest(docs.where("vec_id < 4"), F.col("id") % 20 == 0).collect()
    assert [r["rank"] for r in sorted(few, key=lambda r: r["rank"])] == [1, 2, 3]


def test_neighbours_that_tie(spark):
    rng = np.random.default_rng(2)
    table = np.unique(rng.integers(0, 2, (3000, 11)), axis=0).astype(float)
    table = table[table.any(1)]
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(table)], "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for r in ann.nearest(docs, F.col("id") % 50 == 0, k=20, pack_rows=300, sure=1 - 1e-12).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert len(got) == -(-len(table) // 50)
    for q, rows in got.items():
        s = table @ table[q]
        order = [int(i) for i in np.lexsort((np.arange(len(table)), -s)) if i != q][:20]
        assert [(r, i, x) for r, i, x in sorted(rows)] == [(r + 1, i, s[i]) for r, i in enumerate(order)]


@pytest.mark.parametrize("kind", ["given", "clustered"])
def test_recall_and_cells_seen(spark, kind):
    if kind == "given":
        docs = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
        pairs = sorted((r["vec_id"], r["embedding"]) for r in docs.collect())
        table = np.array([v for _, v in pairs])
    else:
        rng = np.random.default_rng(4)
        centres = rng.normal(size=(40, 32)) * 4
        table = centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 32)) * 0.3
        docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(table)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(docs, F.col("id") % 20 == 0, pack_rows=250).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q, found in got.items():
        s = table @ table[q]
        s[q] = -np.inf
        hits += len(found & set(np.argsort(-s)[:20].tolist()))
    assert len(got) == -(-len(table) // 20) and hits >= 0.9 * 20 * len(got)
    if kind == "clustered":  # where there is something to skip, most cells are skipped
        longest = float(np.sqrt((table**2).sum(1)).max())
        axes = ann.directions(32)
        cells = ann.Cells(ann.projected(table, longest, axes), 16)
        own = cells.of(ann.projected(table, longest, axes))
        points = ann.projected(table, longest, axes)
        low, high = (np.array([f(points[own == c], 0) for c in range(cells.count)]) for f in (np.min, np.max))
        queries = table[::20]
        scores = np.sort(queries @ table.T, axis=1)[:, -21]
        kth = scores * longest / np.sqrt((queries**2).sum(1))
        bounds = ann.box_bounds(low, high, ann.stretched(queries, longest) @ axes[:-1])
        assert (~ann.settled(bounds, kth[:, None], longest, ann.M, ann.SURE)).mean() < 0.7


def test_cells_cut_at_medians():
    points = np.random.default_rng(1).normal(size=(1000, 3))
    cells = ann.Cells(points, 7)
    sizes = np.bincount(cells.of(points), minlength=7)
    assert cells.count == 7 and sizes.min() > 100
    assert ann.Cells(np.zeros((5, 3)), 4).count == 1 and ann.Cells(points[:0], 1).of(points).tolist() == [0] * 1000


def test_chi_square():
    assert abs(float(ann.chi_square_cdf(np.array([15.507]), 8)[0]) - 0.95) < 1e-4


def _mix_docs(spark):
    rows = [(i, "w " * (1 + i * 7 % 40), "abcde"[i % 5] if i % 5 else "a") for i in range(400)]
    rows += [(1000 + i, "w " * 30, None) for i in range(40)] + [(2000, None, "b"), (2001, "", "zz"), (2002, " \n", "b"), (3000, "w " * 5000, "tiny"), (1, "w w w", "a")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))


def test_mixing(spark):
    docs = _mix_docs(spark)
    got = mixing.taken(docs, shards=5, block_words=200).collect()
    assert len(got) == docs.count()
    sizes = {}
    for r in docs.collect():
        sizes[r["source"]] = sizes.get(r["source"], 0) + len((r["text"] or "").split())
    names = sorted((s for s in sizes if s is not None)) + [None]
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), {s for s in names if sizes[s] == 0}
    while True:
        unit = (total - sum(3 * sizes[s] for s in capped)) / sum(weights[s] for s in names if s not in capped)
        above = {s for s in names if s not in capped and weights[s] * unit > 3 * sizes[s]}
        if not above:
            break
        capped |= above
    by_source = {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["source_size"] == sizes[r["source"]]
        by_source.setdefault(r["source"], []).append(r)
    for s, rows in by_source.items():
        target = 3 * sizes[s] if s in capped else weights[s] * unit
        assert abs(rows[0]["target"] - target) < 1e-6
        assert abs(sum(r["taken"] for r in rows) - target) <= 1
    again = mixing.taken(docs.repartition(7), shards=5, block_words=200).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_shards_get_equal_blocks(spark):
    drawn, _ = mixing.mix(_mix_docs(spark), shards=4, block_words=100)
    rows = drawn.collect()
    words = {}
    for r in rows:
        words[r["shard"]] = words.get(r["shard"], 0) + r["words"]
    assert set(words) == set(range(4)) and len({(r["number"], r["pos"], r["pass"]) for r in rows}) == len(rows)


def test_permutation(spark):
    for size in (1, 2, 7, 1000, 4096):
        rows = spark.range(size).select("id", mixing.permuted(F.col("id"), F.lit(size), F.lit(9)).alias("to"), mixing.permuted(F.col("id"), F.lit(size), F.lit(10)).alias("other")).collect()
        assert sorted(r["to"] for r in rows) == list(range(size))
    steps = {(b["to"] - a["to"]) % size for a, b in zip(rows, rows[1:], strict=False)}
    assert len(steps) > 2000 and sum(r["to"] == r["other"] for r in rows) < 20


def test_mixed_shards_are_shuffled(spark, tmp_path):
    docs = _mix_docs(spark)
    got = mixing.mixed(docs, shards=4, block_words=100)
    rows = got.withColumn("part", F.spark_partition_id()).collect()
    assert got.columns == [*docs.columns, "shard", "place"]
    for shard in range(4):
        mine = [r for r in rows if r["shard"] == shard]
        assert len({r["part"] for r in mine}) == 1 and [r["place"] for r in mine] == sorted(r["place"] for r in mine)
        assert [r["doc_id"] or 0 for r in mine] != sorted(r["doc_id"] or 0 for r in mine)
    taken = {}
    for r in mixing.taken(docs, shards=4, block_words=100).collect():
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    words = {}
    for r in rows:
        words[r["source"]] = words.get(r["source"], 0) + len(r["text"].split())
    assert words == {s: n for s, n in taken.items() if n}
    mixing.write_shards(docs, str(tmp_path / "out"), shards=4, block_words=100)
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(rows)


@pytest.mark.parametrize("subtrees", [2, 4096])
def test_splitting_tree_uses_quotas_up(spark, subtrees):
    from markwright.llm.common import Scratch

    quotas = spark.createDataFrame([(0, 100), (1, 7), (2, 0), (3, 33)], "number int, quota long")
    leaves = mixing.splitting_tree(quotas, 8, Scratch(spark, "test"), subtrees=subtrees).collect()
    for number, quota in ((0, 100), (1, 7), (3, 33)):
        mine = sorted((r["before"], r["quota"]) for r in leaves if r["number"] == number)
        assert sum(q for _, q in mine) == quota
        assert all(b == sum(q for _, q in mine[:k]) for k, (b, _) in enumerate(mine))
    per_shard = [sum(r["quota"] for r in leaves if r["shard"] == s) for s in range(8)]
    assert max(per_shard) - min(per_shard) <= 3


def test_mix_of_nothing(spark):
    assert mixing.taken(_mix_docs(spark).limit(0)).count() == 0
    assert [r["taken"] for r in mixing.taken(_mix_docs(spark).where("doc_id IN (2000, 2001)")).collect()] == [0, 0]


@pytest.mark.parametrize("kind", ["byte", "bit"])
@pytest.mark.parametrize("n", [1, 63, 64, 65, 1000])
def test_planes_round_trip(kind, n):
    ids = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint64).astype("<u4")
    data, lengths = token_output.to_planes(ids, 64, kind)
    assert (token_output.from_planes(data, lengths, n, 64, kind) == ids).all()


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_token_output(spark, file):
    path = token_output.vocabulary(file)
    rows = [(3, "Hello, WORLD! it's"), (1, None), (2, ""), (7, "x " * 5000), (5, "été ß\t\nend"), (3, "Again"), (None, "first"), (9, "a  b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit("clash")).repartition(3)
    got = token_output.round_trip(docs, path, block=64, chunk_ids=500, kind="bit").collect()
    tokenizer, at, want = Tokenizer.from_file(path), 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert token_output.round_trip(docs.limit(0), path).count() == 0


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_added_tokens_are_matched_in_the_raw_text(spark, file):
    path = token_output.vocabulary(file)
    tokenizer = Tokenizer.from_file(path)
    contents = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    assert contents
    forms = [f for c in contents for f in (c, c.upper(), c.title())]
    texts = forms + [f"{a}{f}{b}" for f in forms for a, b in (("x", ""), ("", "x"), ("Some words, ", "."), ("a\n", " b."), ("(", ")!"))]
    texts += [c[:-1] for c in contents] + [contents[0] * 3, "One " + " Two. ".join(forms), contents[0][:4] + " " + contents[0][4:]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in token_output.round_trip(docs, path).collect()}
    for i, text in enumerate(texts):
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [2]
        assert got[i] == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), text


def test_words_are_encoded_as_the_library_does():
    words = token_output.WordIds(token_output.vocabulary("word_bpe_49k.json"))
    assert words.by_word and not token_output.WordIds(token_output.vocabulary("byte_bpe_50k.json")).by_word
    rng = np.random.default_rng(6)
    letters = [*"abcXYZ", *"éßÿñÉÀ÷ ×", *"'.,-#|<>", *"019", "\u0301", "J\u030c", "h\u0331", "İ", "Σ", "ς", "ǅ", "日本", "\u00a0", "\u2028", "\x1c", "\n", "\t", "'s", "'t", "'LL", "ﬁ", "\U0001f600", "한", "\u1112\u1161"]
    texts = ["".join(letters[i] for i in rng.integers(0, len(letters), rng.integers(0, 30))) for _ in range(4000)]
    texts += [a + b for a in letters for b in letters]
    whole = words.tokenizer.encode_batch(texts, add_special_tokens=False)
    for text, want in zip(texts, whole, strict=True):
        assert np.frombuffer(words.encode(text.encode()), "<u4").tolist() == want.ids, repr(text)
    small = token_output.WordIds(token_output.vocabulary("word_bpe_49k.json"))
    small.LIMIT, small.BYTES = 3, 50
    assert all(small.encode(t.encode()) == words.encode(t.encode()) for t in texts[:500]) and len(small) <= 4


def test_pipeline(spark):
    import corpus_pipeline

    docs, seen = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA).cache()
        seen.append((name, docs, out))
        docs = out
    language, near, clean, mixed, ids = (s[2] for s in seen)
    assert all(s[2].columns == seen[0][1].columns for s in seen[:4])
    assert language.count() >= 0.97 * seen[0][1].count()
    groups = {}
    for r in corpus_pipeline.ngram_join.ngram_components(language).collect():
        groups.setdefault(r["component_id"], []).append(r["doc_id"])
    assert {r["doc_id"] for r in near.collect()} == set(groups)
    words = mixing.word_count(F.col("text"))
    before = {r["doc_id"]: (r["text"], r["w"]) for r in clean.select("doc_id", "text", words.alias("w")).collect()}
    want = {r["doc_id"]: r["taken"] for r in mixing.taken(clean).collect()}
    got = {}
    for r in mixed.select("doc_id", "text", words.alias("w")).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["w"]
        assert before[r["doc_id"]][0].startswith(r["text"])
    assert got == {i: n for i, n in want.items() if n}
    assert ids.count() == mixed.count()


def _twins(spark):
    rows = [(i, f"w{i} " * (1 + i * 7 % 40), "abcde"[i % 5]) for i in range(100)]
    rows += [(None, f"n{i} " * (5 + i % 3), "a" if i % 2 else None) for i in range(40)]
    rows += [(7, "long " * 60, "c"), (7, "short " * 3, "c"), (7, "alike " * 3, "c"), (8, "w8 " * 17, "d"), (None, None, "a"), (9, "", "e")]
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def test_mixing_stage_keeps_rows_apart(spark):
    import corpus_pipeline

    docs = _twins(spark)
    got = corpus_pipeline.mixing_stage(spark, docs, DATA).collect()
    want = {}
    for r in mixing.taken(docs).collect():
        key = (r["doc_id"], r["source"], r["size"])
        want[key] = want.get(key, 0) + r["taken"]
    known = {(r["text"] or "").split()[0]: r for r in docs.collect() if (r["text"] or "").split()}
    found = {}
    for r in got:
        of = known[r["text"].split()[0]]
        assert (r["doc_id"], r["source"]) == (of["doc_id"], of["source"]) and of["text"].startswith(r["text"]) and r["n_chars"] == len(r["text"])
        key = (r["doc_id"], r["source"], len(of["text"].split()))
        found[key] = found.get(key, 0) + len(r["text"].split())
    assert found == {k: n for k, n in want.items() if n}
    assert any(k[0] is None for k in found)


def test_near_duplicate_stage_with_null_and_repeated_ids(spark):
    import corpus_pipeline

    text = lambda k: " ".join(f"{k}{i}" for i in range(40))
    rows = [(1, text("a")), (1, text("a")), (1, text("b")), (2, text("b")), (None, text("c")), (None, text("c")), (None, text("a")), (3, text("d")), (4, text("d") + " x"), (None, text("e")), (5, None), (5, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = [(r["doc_id"], (r["text"] or "")[:2]) for r in corpus_pipeline.ngram_join_stage(spark, docs, DATA).collect()]
    want = [(1, "a0"), (2, "b0"), (None, "c0"), (3, "d0"), (None, "e0"), (5, ""), (5, ""), (None, "")]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_neighbours_move_no_vector_for_each_cell(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(6)
    table = rng.normal(size=(2000, 64))
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(table)], "vec_id long, embedding array<double>")
    runs = []
    for kind, size in (("whole", 1 << 24), ("blocks", 30_000)):
        monkeypatch.setattr(ann, "QUERY_BYTES", size, raising=False)
        monkeypatch.setattr(common, "shared_dir", lambda _, kind=kind: f"file://{tmp_path}/{kind}")
        runs.append(sorted(map(tuple, ann.nearest(docs, F.col("id") % 20 == 0, pack_rows=50).collect())))
        files = [pq.ParquetFile(p) for p in (tmp_path / kind).rglob("*.parquet")]
        # once each query's vector was written twice for each of the 40 cells
        assert sum(f.metadata.num_rows for f in files if "v" in f.schema_arrow.names) == 2100
    assert runs[0] == runs[1]
    hits = 0
    for q in range(0, 2000, 20):
        s = table @ table[q]
        s[q] = -np.inf
        hits += len({r[2] for r in runs[0] if r[0] == q} & set(np.argsort(-s)[:20].tolist()))
    assert len(runs[0]) == 100 * 20 and hits >= 0.9 * len(runs[0])
