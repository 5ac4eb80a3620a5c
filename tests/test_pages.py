import datetime

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from markwright.functions import pages as pg
from markwright.operators import corpus


def val(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lit_array(*items):
    return F.array(*map(F.lit, items))


def test_anchors_carry_on(spark):
    lines = ["(b) too early", "1(a) Find", "12. State", "(b) Show [4]", "plain 3 marks", "A2 Section", "7"]
    rows = spark.createDataFrame([("d", i, x) for i, x in enumerate(lines)], "d string, i int, x string")
    got = [(r["number"], r["sub"], r["anchored"], r["marks"]) for r in corpus.anchored_lines(rows, "d", "i", "x").orderBy("i").collect()]
    assert got == [(None, None, False, None), ("1", "(a)", True, None), ("12", None, True, None), ("12", "(b)", True, 4), ("12", None, False, 3), ("2", None, True, None), ("2", None, False, None)]


def test_words_and_middle(spark):
    assert val(spark, pg.word_estimate(F.lit("a b c"))) == 3
    assert val(spark, pg.word_estimate(F.lit("x" * 52))) == 10
    assert val(spark, pg.middle(lit_array(5, 0, -1, 9, 7))) == 7 and val(spark, pg.middle(lit_array(5, 8))) == 6 and val(spark, pg.middle(lit_array(0))) == 0


def test_schemes_and_controls(spark):
    assert val(spark, pg.scheme_usable(F.lit("Any three from: mark scheme x"))) is False
    assert val(spark, pg.scheme_usable(F.lit("photosynthesis needs light"))) is True
    assert val(spark, pg.strip_controls(F.lit('a\x07b\n{"k": "\\u0007x"}'))) == 'ab\n{"k": "x"}'
    assert val(spark, pg.name_slug(F.lit("Zoë O'Brien-Ñandú the third"))) == "zoeobriennanduthethi"


def test_layouts(spark):
    assert val(spark, pg.mcq_layout(F.lit("A x\nB y\nC z\nD w"))) is True
    assert val(spark, pg.mcq_stem(F.lit("Which gas is it"))) is True
    assert val(spark, pg.mcq_stem(F.lit("the law"))) is False and val(spark, pg.mcq_stem(F.lit("Turn over the page now please"))) is False


def test_context_and_anchor(spark):
    text = F.lit("one two three four five six seven eight nine")
    assert val(spark, pg.context(text, F.lit("five"), 2)) == "three four five six seven"
    assert val(spark, pg.context(text, F.lit("one"), 2)) == "one two three"
    assert val(spark, pg.anchored(text, F.lit("Four, five"))) is True
    assert val(spark, pg.anchored(text, F.lit("four"))) is False


def test_pages(spark):
    assert val(spark, pg.page_excluded(lit_array(*[f"5070/2{i}" for i in range(9)]))) == "footer_heavy_page"
    assert val(spark, pg.page_excluded(lit_array("real words", "more words", *map(str, range(8))))) is None
    assert val(spark, pg.page_excluded(lit_array("x", "BLANK PAGE"))) == "blank_page"
    assert val(spark, pg.header_conflicts(F.lit("Chemistry 5070"), F.lit("Physics"))) is True and val(spark, pg.header_conflicts(F.lit("Mathematics D"), F.lit("Additional Mathematics"))) is False
    assert val(spark, pg.on_page(F.lit("… The CELL wall is rigid …"), F.lit("the cell-wall"))) is True
    assert val(spark, pg.in_any_box(F.lit(5.0), F.lit(5.0), F.array(F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(4.0).alias("x1"), F.lit(9.0).alias("y1"))), 1.0)) is True


def test_names(spark):
    assert val(spark, pg.path_key(F.lit("a / b/ c "))) == "a/b/c"
    assert val(spark, pg.subject_matches(F.lit("Maths"), F.lit("maths d"))) is True
    assert val(spark, pg.subject_matches(F.lit("Mat"), F.lit("maths"))) is False
    days = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(datetime.date(*d)).alias("day")) for n, d in (("June", (2025, 6, 1)), ("Nov", (2025, 11, 1)))])
    assert val(spark, pg.next_session(days, F.lit(datetime.date(2025, 7, 1)))) == "Nov"
    assert val(spark, pg.next_session(days, F.lit(datetime.date(2026, 7, 1)))) == "Nov"


def test_nested(spark):
    parts = [Row(label="(a)", text="t", subparts=[Row(label="(i)", text="u")]), Row(label="(b)", text="v", subparts=None)]
    rows = spark.createDataFrame([(parts,)], "p array<struct<label:string,text:string,subparts:array<struct<label:string,text:string>>>>")
    assert [tuple(x) for x in rows.select(pg.flat_parts(F.col("p")).alias("x")).first()["x"]] == [("(a)", "t"), ("(a)(i)", "u"), ("(b)", "v")]
    assert [tuple(x) for x in val(spark, pg.options_from_list(lit_array("x", "y")))] == [("A", "x"), ("B", "y")]
    assert [tuple(x) for x in val(spark, pg.options_from_map(F.create_map(F.lit("B"), F.lit("y"), F.lit("A"), F.lit("x"))))] == [("A", "x"), ("B", "y")]
    assert val(spark, pg.answer_slots(F.lit("q1"), lit_array("x", "y"))) == {"q1::0": "x", "q1::1": "y"}


def test_rules(spark):
    assert val(spark, pg.foreign_paper(lit_array(1, 2, 3), lit_array(7, 8, 9))) is True
    assert val(spark, pg.foreign_paper(lit_array(1, 2, 3), lit_array(1, 2, 9))) is False
    at = F.lit(datetime.datetime(2025, 1, 1))
    assert val(spark, pg.retry_blocked(at, F.lit(datetime.datetime(2025, 1, 1, 23)))) is True
    assert val(spark, pg.retry_blocked(at, F.lit(datetime.datetime(2025, 1, 2)))) is False
    assert val(spark, pg.escalate(F.lit(True), F.lit(0.9), lit_array("x"), ["y"])) is False
    assert val(spark, pg.repair_accepted(F.lit(0.5), F.lit(0.6), lit_array(0.7))) is False


def test_boilerplate_goes_with_what_follows_it(spark):
    clean = lambda x: val(spark, pg.without_boilerplate(F.lit(x)))
    assert clean("Find x.\n 12 13 Permission to reproduce items where\nmore") == "Find x."
    assert clean("DFDDFD,,,, Why?") == "Why?" and clean("DFD represents flow") == "DFD represents flow" and clean(" :: So") == "So"
    assert clean("a BLANK PAGE b") == "a  b" and clean("end the live examination series. Local Examinations Syndicate (UCLES), which is itself a department of the University of Cambridge. x") == "end  x"


def test_slugs_of_all_scripts(spark):
    assert val(spark, pg.name_slug(F.lit("Łukasz Šťastný Đặng"))) == "ukaszstastnyang"
    assert val(spark, pg.name_slug(F.lit("İlker ǅ"))) == "ilker"


def test_corrections_that_hold(spark):
    page = "The quick brown fox jumps over the lazy dog. Teh end"
    holds = lambda q, a, b: val(spark, pg.correction_holds(F.lit(page), F.lit(q), F.lit(a), F.lit(b)))
    assert holds("Teh  end", "Teh", "The") and holds("brown fox jumps over the", "fox", "ox")
    assert not holds("Teh", "Teh", "The") and not holds("quick brown fox", "own", "owl") and not holds("brown fox jumps", "fox", "Fox,")
    assert not holds("not on the page", "page", "pages") and not holds("Teh end", "Teh", None) and not holds("Teh end", "", "x")


def test_structured_items(spark):
    from markwright.operators import corpus

    lines = [(1, 1, "header"), (1, 2, "1 (a) Why is the sky blue? [2]"), (1, 3, "Explain [4]"), (1, 4, "250 is too large"), (1, 5, "Please turn over"), (2, 6, "(b) And the sea?"), (2, 7, "2015/12 page"), (3, 8, "2. On a page"), (3, 9, "BLANK PAGE"), (4, 10, "3"), (4, 11, "A4 Last one"), (4, 12, "(ii)")]
    got = corpus.structured_items(spark.createDataFrame([("p", *x) for x in lines], "paper string, page int, at int, t string"), "paper", "page", "at", "t").orderBy("item").collect()
    assert [(r["number"], r["sub"], r["text"], r["page"], r["marks"]) for r in got] == [(1, "(a)", "Why is the sky blue? Explain 250 is too large", 1, 4), (1, "(b)", "And the sea? 2015/12 page 3", 2, None), (4, None, "Last one (ii)", 4, None)]


def test_a_page_is_prepared_once_for_all_its_lines(spark):
    from markwright.plans.papers import checked_corrections, line_fields

    for query in (line_fields, checked_corrections):
        above = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().split("Generate")[0]
        assert "lower(page" not in above and "coalesce(page" not in above and "replace(page" not in above
    page = pg.bare(F.lit("… The CELL wall is rigid …"))
    assert val(spark, pg.on_bare_page(page, F.lit("the cell-wall"))) is True and val(spark, pg.on_bare_page(page, F.lit("…"))) is False
