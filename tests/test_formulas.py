"""Forms of formulas: stated cases, and generated ones against rules that look at one gap at a time."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from markwright.functions import formulas as fm


@pytest.mark.parametrize(
    ("x", "display", "canonical", "matcher"),
    [
        ("Solve log_3(x) + log₉(x) = 12", "Solve log_3 (x) + log_9 (x) = 12", "Solve log(base=3,arg=x) + log(base=9,arg=x) = 12", "Solve log(base=3,arg=x) + log(base=9,arg=x) = 12"),
        ("Solve log3x + log9x = 12", "Solve log3x + log9x = 12", None, "Solve log3x log9x 12"),
        ("log₂⁵ a", "log_2^5 a", None, "log base 2 power 5 a"),
        ("log₁₀100", "log_10 100", "log(base=10,arg=100)", "log(base=10,arg=100)"),
        ("log( base = 2 , argz = x + 1 )", "log (base = 2 , argz = x + 1)", "log(base=2,arg=x+1)", "log(base=2,arg=x+1)"),
        ("x² +y³", "x^2 + y^3", "x² +y³", "x² +y³"),
        ("H₂O", "H₂O", "H₂O", "H₂O"),
        ("a ≤ √b, log a", "a ≤ √b, log a", None, "a le sqrt b log a"),
        ("xÂ² + 1", "x^2 + 1", "x² + 1", "x² + 1"),
        ("  ", "", None, ""),
        (None, "", None, ""),
    ],
)
def test_forms(x, display, canonical, matcher):
    assert fm.math_forms(x)[:3] == (display, canonical, matcher)


@pytest.mark.parametrize(
    ("x", "codes"),
    [
        ("log3x", ["ambiguous_log_base_argument", "canonical_math_missing"]), ("log 3x", ["ambiguous_log_base_argument", "canonical_math_missing"]), ("log₂3 = y", ["merged_log_base_operand"]), ("log_12x", ["merged_log_base_operand"]),
        ("x�", ["subscript_decoding_uncertain", "superscript_decoding_uncertain"]), ("x₊₁", ["subscript_decoding_uncertain"]), ("xÂ²", ["superscript_decoding_uncertain"]), ("x = 1", []), ("logs", ["canonical_math_missing"]),
    ],
)
def test_doubts(x, codes):
    assert fm.math_forms(x).warnings == codes


def test_a_given_canonical_form_goes_first():
    assert fm.math_forms("log3x", "log(base=3,arg=x)")[1:] == ("log(base=3,arg=x)", "log(base=3,arg=x)", [])
    assert fm.math_forms("log_3(x)", "log of x").canonical == "log(base=3,arg=x)"
    assert fm.math_forms("log_3(x)", canonical=False)[1:] == (None, "log base 3 x", [])


@pytest.mark.parametrize(
    ("x", "want"),
    [
        ("solve log x = 2", "solve log base 10 x = 2"), ("lg 5", "log base 10 5"), ("logic and logarithm", "logic and logarithm"), ("log base 2 x", "log base 2 x"), ("log_3 x", "log_3 x"), ("ln x", "ln x"),
        ("log base 10 y", "log base 10 y"), ("log(base=10,arg=x)", "log base 10 x"), ("log(base=2,arg=x)", "log(base=2,arg=x)"), ("log(x)", "log base 10(x)"), ("catalog 3", "catalog 3"), ("LG y", "log base 10 y"),
    ],
)
def test_common_log(x, want):
    assert fm.common_log(x) == want == fm.common_log(want)


def test_common_logarithms_are_matched_alike():
    assert fm.matched_on("lg y") == fm.matched_on("log y") == "log base 10 y"
    assert fm.matched_on("ln y") == "ln y"
    assert fm.matched_on("Solve log_10(x) = 2") == "Solve log base 10 x = 2"
    assert fm.matched_on("x − 1") == "x - 1"


def test_forms_and_what_they_are_matched_on(spark):
    texts = ["Solve log_10(x)  − 2", "lg y", "log y", "x² = 1", None, "", " log₂( a ) "]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select("t", fm.math_normalised(F.col("t")).alias("f"))
    assert [(*r["f"],) for r in frame.collect()] == [(*fm.math_forms(t), fm.matched_on(t)) for t in texts]


def test_kinds_of_content(spark):
    rows = [("Co2 is 5ms", "science_notation", "Chemistry 1011"), ("lg t = 3", "symbolic", " Mathematics  1014"), ("lg t = 3", "symbolic", None), ("“Hello” , ﬁne .", "prose", "x"), ("", "prose", None), (None, "prose", None)]
    frame = spark.createDataFrame(rows, "t string, k string, s string").select(fm.content_normalised(F.col("t"), F.col("k"), F.col("s")).alias("f"))
    got = [tuple(r["f"]) for r in frame.collect()]
    assert got[0] == ("Co2 is 5ms", None, "Co2 is 5ms", ["ambiguous_science_formula_case"])
    assert got[1] == ("lg t = 3", "lg t = 3", "log base 10 t = 3", []) and got[2] == ("lg t = 3", None, "lg t 3", [])
    assert got[3] == ('"Hello", fine.', None, "hello fine", []) and got[4] == got[5] == ("", None, "", ["empty_text"])


SUP, SUB = dict(zip("⁰¹²³⁴⁵⁶⁷⁸⁹", "0123456789", strict=True)), dict(zip("₀₁₂₃₄₅₆₇₈₉", "0123456789", strict=True))


def _slow_display(x):
    """Pieces found one character at a time, then a look at each gap between two of them."""
    pieces, i = [], 0  # (text, a blank was there before, signs want blanks, a blank is wanted after)
    gap = False
    while i < len(x):
        if x[i].isspace():
            gap, i = True, i + 1
            continue
        low, j = x[i : i + 3].lower() == "log", i + 3
        while low and j < len(x) and x[j] in SUB:
            j += 1
        glued = re.match(r"(?i)log_\d+(?=[a-z(])", x[i:])
        if low and j > i + 3:
            pieces.append((x[i : i + 3] + "_" + "".join(SUB[c] for c in x[i + 3 : j]), gap, False, j < len(x) and x[j] not in " \t\r\n+-=*/^)],:"))
            i = j
        elif glued:
            pieces.append((glued[0].lower(), gap, False, True))
            i += len(glued[0])
        elif x[i] in SUP:
            j = i
            while j < len(x) and x[j] in SUP:
                j += 1
            pieces.append(("^" + "".join(SUP[c] for c in x[i:j]), gap, False, False))
            i = j
        else:
            n = 3 if low else 1
            pieces.append((x[i : i + n], gap, x[i] in "=+-*/()", False))
            i += n
        gap = False
    out = ""
    for k, (t, before, sign, _) in enumerate(pieces):
        if k:
            last = pieces[k - 1]
            if (before or sign or last[2] or last[3]) and last[0] != "(" and t != ")" and t[0] != "^":
                out += " "
        out += t
    return out


def test_generated_formulas():
    rng = np.random.default_rng(8)
    bits = ["log", "LOG", "log_2", "log_10", "Log_3", "lg", "ln", "x", "yz", "3", "12", " ", "  ", "\t", "(", ")", "+", "-", "=", "*", "/", "^", "²", "¹⁰", "₂", "₁₀", "log₂", "log₁₀", ",", ":", "é", "catalog"]
    for _ in range(6000):
        x = "".join(bits[i] for i in rng.integers(0, len(bits), rng.integers(0, 14)))
        assert fm.displayed(x) == _slow_display(x), x
        assert fm.displayed(fm.displayed(x)) == fm.displayed(x) or "log" in x.lower()


def test_many_formulas_are_read_as_one(monkeypatch):
    rng = np.random.default_rng(9)
    bits = ["log", "LOG_2", "lg", "ln", "x", "12", " ", "\n", "(", ")", "+", "-", "=", "^", "²", "₁₀", "log₁₀", ",", "log(base=10,arg=x)", "log ( base = 2 , argz =", "base", "Â²", "�", "−", "≤", "ſ"]
    texts = [None, "", " ", "log", "x\0 log₂(3)", "\0"] + ["".join(bits[i] for i in rng.integers(0, len(bits), rng.integers(0, 12))) for _ in range(3000)]
    for some in (texts, texts[6:], [t for t in texts[6:] if not re.search("[Â�−]", t)], ["\0"], []):
        assert fm.all_forms(some) == [(fm.math_forms(x), fm.matched_on(x)) for x in some]
    shown, calls = fm.displayed, []
    monkeypatch.setattr(fm, "displayed", lambda *a: calls.append(1) or shown(*a))
    fm.all_forms([f"log_2(x) + lg {i} = y²" for i in range(1000)])
    assert len(calls) == 1  # once it was a pass over the characters of each formula


def test_long_arguments_and_bases_are_read_whole():
    arg = " + ".join(f"x{i}" for i in range(400))
    assert fm.math_forms(f"log_2({arg})").canonical == f"log(base=2,arg={arg.replace(' ', '')})"
    assert fm.displayed("log" + "₁₂" * 40 + "x") == "log_" + "12" * 40 + " x"


def test_forms_of_documents_go_in_pieces():
    import pyarrow as pa

    texts = ["log₂8 = 3", None, "x² + 1", "", "y " * 50, "a=b"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts)], names=["id", "t"])
    pieces = list(fm._formed(iter([batch]), 1, 10))
    assert [p.num_rows for p in pieces] == [3, 2, 1] and pa.Table.from_batches(pieces)["id"].to_pylist() == list(range(6))
    got = pa.Table.from_batches(pieces)["forms"].to_pylist()
    assert [(g["display"], g["canonical"], g["matcher"], g["warnings"]) for g in got] == [tuple(fm.math_forms(x)) for x in texts]
    assert [g["matched"] for g in got] == [fm.matched_on(x) for x in texts]
