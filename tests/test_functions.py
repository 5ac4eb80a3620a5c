import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from markwright.functions import exprs as ex
from markwright.functions import text as tx
from markwright.functions import sequences, udfs


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double'}" for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("x,want", [(2.5, 3), (-2.5, -2), (0.49, 0), (-0.5, 0)])
def test_half_up(spark, x, want):
    assert one(spark, ex.half_up(F.col("a")), a=x) == want


def test_percent_of_nothing(spark):
    assert one(spark, ex.percent(F.col("a"), F.lit(0.0), 0), a=1.0) == 0
    assert one(spark, ex.percent(F.col("a"), F.lit(0.0)), a=1.0) is None


@pytest.mark.parametrize("x,want", [(95.0, "A*"), (90.0, "A*"), (89.9, "A"), (40.0, "E"), (39.0, "U")])
def test_grade_band(spark, x, want):
    assert one(spark, ex.grade_band(F.col("a")), a=x) == want


@pytest.mark.parametrize("x,want", [("N/A", None), (" none ", None), ("", None), ("maths", "maths")])
def test_placeholder(spark, x, want):
    assert one(spark, ex.placeholder_to_null(F.col("a")), a=x) == want


@pytest.mark.parametrize("key,want", [("a|b|c|d|e", True), ("a|b|c|d", False), ("a|b| |d|e", False), ("a|b|c|d|e|f", False)])
def test_paper_key(spark, key, want):
    assert one(spark, ex.is_paper_key(F.col("a")), a=key) is want


def test_clean_names(spark):
    got = one(spark, ex.clean_names(F.split("a", ";")), a=" Ann ;bob;ANN; ;Cy")
    assert got == ["ANN", "bob", "Cy"]


def test_touching_intervals_do_not_overlap(spark):
    assert one(spark, ex.overlaps(F.lit(1), F.lit(2), F.lit(2), F.lit(3)), a=1.0) is False
    assert one(spark, ex.overlaps(F.lit(1), F.lit(2), F.lit(1), F.lit(2)), a=1.0) is True


def test_normalize_folds(spark):
    assert one(spark, tx.normalize(F.col("a")), a="H₂O, cm³ – 5×3 → Ü") == "h2o cm3 5 3"


def test_normalize_is_idempotent(spark):
    @settings(max_examples=15, deadline=None)
    @given(st.text(max_size=40))
    def check(s):
        once = one(spark, tx.normalize(F.col("a")), a=s.replace("\x00", ""))
        assert one(spark, tx.normalize(F.col("a")), a=once) == once

    check()


def test_overlap_and_jaccard(spark):
    q, c = tx.token_set(F.col("a")), tx.token_set(F.col("b"))
    assert one(spark, tx.overlap(q, c), a="water formula", b="the formula of water") == 1.0
    assert one(spark, tx.jaccard(q, c), a="water formula", b="the formula of water") == 0.5
    assert one(spark, tx.jaccard(q, c), a="", b="x") == 0.0


@pytest.mark.parametrize("x,want", [("Question 12 on", 12), ("999 then q3", 3), ("none", None)])
def test_question_number(spark, x, want):
    assert one(spark, tx.question_number(F.col("a")), a=x) == want


@pytest.mark.parametrize("x,want", [("b", "B"), ("Ans: c", "C"), ("I think D fits", "D"), ("a. b", "B"), ("nothing", None), ("", None)])
def test_student_option(spark, x, want):
    assert one(spark, tx.student_option(F.col("a")), a=x) == want


@pytest.mark.parametrize("x,want", [(" b ", "B"), ("The correct answer is C", "C"), ("answer - d", "D"), ("Option a is correct", "A"), ("A gas that burns", None), ("", None)])
def test_scheme_option(spark, x, want):
    assert one(spark, tx.scheme_option(F.col("a")), a=x) == want


@pytest.mark.parametrize(
    "x,subject,kind,family",
    [
        ("Choose the right gas", "", "mcq_structured", "prose_or_structured"), ("Find x if 2x = 4", "", "symbolic", "generic_equation"), ("H2O is formed", "Chemistry 1011", "science_notation", "science_formula_units"),
        ("Mass of 5kg = 5", "", "science_notation", "science_formula_units"), ("log x = 2", "", "symbolic", "logarithmic"), ("f(x) is given", "", "symbolic", "function_expression"), ("because water always boils under lower pressure", "", "prose", "prose_or_structured"), ("B", "", "mcq_structured", "prose_or_structured"),
    ],
)
def test_content_type(spark, x, subject, kind, family):
    assert one(spark, tx.content_type(F.col("a"), None, F.col("b")), a=x, b=subject) == kind
    assert one(spark, tx.question_family(F.col("a"), F.lit(kind)), a=x) == family


@pytest.mark.parametrize("bad,good,want", [("bat", "kat", True), ("cat", "cot", True), ("rn", "m", True), ("s0", "so", True), ("bat", "cat", False), ("gqq", "qgg", False), ("vv", "w", False), ("", "a", False), ("same", "same", False)])
def test_confusable(spark, bad, good, want):
    assert one(spark, ex.confusable(F.col("a"), F.col("b")), a=bad, b=good) is want


def test_question_about_papers(spark):
    q = "Which years was photosynthesis asked in Biology in past 8 years?"
    assert [one(spark, c, a=q) for c in (tx.intent(F.col("a")), tx.subject_in(F.col("a")), tx.years_asked(F.col("a")), tx.core_topic(F.col("a"), tx.subject_in(F.col("a"))))] == ["paper_lookup", "Biology", 8, "photosynthesis"]
    assert one(spark, tx.acronyms(F.col("a")), a="Explain SSL and GDP") == ["SSL", "GDP"]


def test_expected_points(spark):
    assert one(spark, tx.expected_points(F.col("a")), a="melts at 0; abc\nboils  at 100") == ["melts at 0", "boils at 100"]
    assert one(spark, tx.expected_points(F.col("a")), a="H2") == ["H2"]


def test_mark_range(spark):
    assert tuple(one(spark, tx.mark_range(F.col("a")), a="8–6 marks")) == (6, 8)
    assert tuple(one(spark, tx.mark_range(F.col("a")), a="x")) == (0, 0)


def test_udfs(spark):
    assert one(spark, sequences.sequence_ratio(F.col("a"), F.col("b")), a="water", b="the water") == 1.0
    assert one(spark, udfs.tidy_prose(F.col("a")), a="“A ﬁne  day” .") == '"A fine day".'
    assert one(spark, udfs.repair_mojibake(F.col("a")), a="cafÃ©") == "café"
    assert one(spark, udfs.repair_json(F.col("a")), a='```json\n{"a": [1, 2,], "b": {"c": 3') == '{"a": [1, 2], "b": {"c": 3}}'
    assert [o["label"] for o in one(spark, udfs.inline_options(F.col("a")), a="Pick A red B blue C green D grey")] == list("ABCD")


def test_line_match(spark):
    score = lambda a, b: one(spark, sequences.line_match(F.col("a"), F.col("b")), a=a, b=b)
    assert score("", "x") == 0.0 and score("water boils", "water boils") == 1.0
    assert abs(score("water boils", "the water boils at once") - (0.55 + 0.25 + 0.15 * 2 / 5 + 0.05 * 2 * 11 / 34 + 0.10)) < 1e-9
    assert score("water boils", "a gas") < 0.3



def test_quotes_of_whole_texts_without_python(spark):
    from markwright.plans.records import tidy_starts

    text = "  “One”\n\n‘two’\tthree " + "word " * 40
    assert spark.createDataFrame([(text,)], "t string").select(tx.straight_quotes(F.col("t"))).first()[0] == text.replace("“", '"').replace("”", '"').replace("‘", "'").replace("’", "'")
    plan = tidy_starts(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
