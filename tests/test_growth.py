"""Steps that must not grow faster than their input: what the plans of queries hold, and odd texts."""

import re

import duckdb
from pyspark.sql import functions as F

from markwright.functions import pages as pg
from markwright.functions import text as tx
from markwright.operators import corpus, geometry
from markwright.plans import catalog
from markwright.plans import papers, records  # noqa: F401

DATA = "/root/testdata/sf0.001"


def _plan(df, kind="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


def test_question_chunks_join_nothing(spark):
    assert "Join" not in _plan(catalog.QUERIES["question_chunks"](spark, DATA))
    pages = spark.createDataFrame([(1, 1, "intro\n1. Why"), (1, 2, "more\n3. No\n2) Next"), (2, 1, "nothing"), (3, 1, "1 What")], "doc int, page int, text string")
    got = sorted(map(tuple, corpus.question_chunks(pages).collect()), key=str)
    assert got == sorted([(1, None, 1, "intro"), (1, 1, 1, "1. Why\nmore\n3. No"), (1, 2, 2, "2) Next"), (2, None, 1, "nothing"), (3, 1, 1, "1 What")], key=str)


def test_structured_papers_shuffle_documents_once(spark):
    assert _plan(catalog.QUERIES["structured_papers"](spark, DATA), "executedPlan").count("Exchange") == 1


def test_boilerplate_as_by_one_pattern(spark):
    whole = r"(?is)\s*(?:\b\d{1,3}\b\s+)*(?:if you use the following lined|copyright acknowledgements?\b|©\s*ref:).*$"
    texts = ["a 12 3 Copyright Acknowledgement: x\ny", "b\n 1234 if YOU use the following lined", "c 7 © \nRef: z", "copyright acknowledgementsx d", "Copyright Acknowledgements", "e 5 Copyright Acknowledgements f © Ref: g", "h 12  ", None]
    rows = spark.createDataFrame([(x,) for x in texts], "x string").select("x", pg.without_boilerplate(F.col("x")).alias("y")).collect()
    assert [r["y"] for r in rows] == [None if r["x"] is None else re.sub(whole, "", r["x"], count=1).lstrip() for r in rows]
    wide = spark.range(1).select(pg.without_boilerplate(F.concat(F.lit("a"), F.repeat(F.lit(" "), 300_000), F.lit("b"))).alias("y"))
    assert wide.select(F.length("y")).first()[0] == 300_002  # blanks were searched from each of them


def test_settled_disagreements_need_no_blocks(spark):
    every = papers._disagreements(spark, DATA)
    assert _plan(every).count("ArrowEvalPython") == 2 and "CASE WHEN" in _plan(every.select("page", "math"))


def test_text_fields_normalise_a_text_once(spark):
    assert len(re.findall(r"translate\(coalesce\(text#", _plan(catalog.QUERIES["text_fields"](spark, DATA)))) == 1
    folded = spark.range(1).select(tx.fold(F.lit("x² – 3 → H₂·")).alias("a"), tx.fold(F.lit("plain-é")).alias("b"), tx.fold(F.lit(None).cast("string")).alias("c")).first()
    assert tuple(folded) == ("x2 - 3 -> H2.", "plain-é", "")


def test_words_that_are_equal_are_not_taken_apart(spark):
    assert "levenshtein" in _plan(catalog.QUERIES["visual_confusions"](spark, DATA))


def test_course_files_take_more_parts_not_larger_ones(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")  # as a larger table, the scan has many parts
        scanned = records._lines(spark, DATA).rdd.getNumPartitions()
        for name, keys in (("course_records", ("l_orderkey", "question_id")), ("fallback_records", ("l_orderkey",))):
            plan = _plan(catalog.QUERIES[name](spark, DATA), "executedPlan")
            for key in keys:  # once they were as many as the session's shuffles have
                assert int(re.search(rf"hashpartitioning\({key}#.*?, (\d+)\)", plan)[1]) >= 16 * scanned > 64
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_passages_keep_a_page_in_one_row(spark, tmp_path):
    assert not re.search("Window|Generate|Join", _plan(catalog.QUERIES["passage_lengths"](spark, DATA)))  # each word was a row, sorted several times
    line, many = "The quick brown fox’s tail jumps-over lazy dogs, a b-c-d 'e'.", " ".join(f"w{i}." for i in range(400))
    texts = ["\n".join([line] * 30), "\n \n\t" + many + "\nSuggest a  suitable title\n" + line + "\nÀ la carte.\nPRÉCIS of one two three four five", "", "  \n ", None, "one", "é è ê " * 40 + "\n" + "x " * 90, line + "\r\n" + line + " next \n1 2 3;", "\n" * 50 + many + "\n" * 9 + "q"]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, line), (1, "\n".join(["no"] * 70))]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = catalog.QUERIES["passage_lengths"](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({catalog.ORACLES['passage_lengths']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) == 6


def test_regions_of_thin_and_lower_lines(spark):
    words = [("p", f"w{i}a b c d e", 100.0 * (i % 3), 0.5 * i, 100.0 * (i % 3) + 30, 0.5 * i + 0.25) for i in range(400)] + [("q", "a b c d e.", 0.0, 9.0, 5.0, 3.0), ("q", "z", 0.0, 4.0, 5.0, 6.0), ("q", "end", 0.0, 90.0, 5.0, 99.0)]
    frame = spark.createDataFrame(words, "page string, text string, x0 double, y0 double, x1 double, y1 double").repartition(5)
    got = {r["page"]: r["in_regions"] for r in geometry.passage_words(frame, "page").collect()}
    lines = geometry.line_boxes(geometry.lines_of(frame, "page"), "page", height=F.max("y1")).join(frame.groupBy("page").agg(F.max("y1").alias("h")), "page")
    ok = lines.where(((F.col("y0") + F.col("y1")) / 2).between(F.col("h") * 0.08, F.col("h") * 0.92) & geometry.is_passage(F.col("text"))).collect()
    inside = lambda p, x, y: any(b["page"] == p and b["x0"] - 8 <= x <= b["x1"] + 8 and b["y0"] - 5 <= y <= b["y1"] + 5 for b in ok)
    assert got == {page: sum(len(re.findall(r"\w+", t)) for p, t, x0, y0, x1, y1 in words if p == page and inside(p, (x0 + x1) / 2, (y0 + y1) / 2)) for page in "pq"}
