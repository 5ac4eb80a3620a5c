"""Formulas in three forms: as they are shown, in canonical form, and as they are matched on, with what looks doubtful.

Each rule is a substitution over a whole text. No rule looks past an edge, so that many texts, with an edge between each
two, are read as one: what a rule costs is paid once for thousands of formulas. Texts of any length are read in time
linear in their length.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from markwright.functions import text as tx

_BASES = str.maketrans(tx.SUBSCRIPTS, tx.DIGITS)
_PLAIN = str.maketrans(tx.HYPHENS + tx.SPACES, "-" * len(tx.HYPHENS) + " " * len(tx.SPACES))
_ODD = re.compile(f"[{re.escape(tx.HYPHENS + tx.SPACES)}]")

#: fixed values: signs, and what a lowered base may be followed by without a blank
_SIGNS = "=+-*/()"
_NO_BLANK_AFTER_BASE = re.escape(" \t\r\n+-=*/^)],:")
#: stands between texts that are read as one; a text that holds it is read by itself
_EDGE = "\0"
_LOG = "[lL][oO][gG]"  # not by (?i), with which a search looks closely at each character


class Rules:
    """The patterns, for one text or for texts with an edge between each two."""

    def __init__(self, edge: str = ""):
        self.edge = edge
        #: a lowered base with the character after it that wants a blank; a base that a letter or bracket follows at once; raised digits
        self.based = re.compile(rf"({_LOG})([{tx.SUBSCRIPTS}]+)(?=([^{_NO_BLANK_AFTER_BASE}{edge}])?)")
        self.glued = re.compile(rf"{_LOG}(_\d+)(?=(?i:[a-z(]))")
        self.power = re.compile(f"[{tx.SUPERSCRIPTS}]+")
        #: forms of logarithms
        self.written_log = re.compile(rf"{_LOG}\s*\(\s*(?i:base)\s*=\s*([^,(){edge}]+?)\s*,\s*(?i:argz?)\s*=\s*([^){edge}]+?)\s*\)")
        self.log_of_bracket = re.compile(rf"[lL](?<!\w.)[oO][gG]_((?i:[a-z0-9])+)\s*\(\s*([^){edge}]+?)\s*\)")
        self.log_of_term = re.compile(r"[lL](?<!\w.)[oO][gG]_((?i:[a-z0-9])+)\s+((?i:[a-z0-9])+(?:\^[0-9]+)?)\b")
        self.common_log = re.compile(rf"[lL](?<!(?i:[a-z]).)(?:[gG]\b|[oO][gG](?!\s+(?i:base)\b)(?=[\s({edge}]|$)(?!\s*\(\s*(?i:base)\s*=))")

    def one_blank(self, x: str) -> str:
        x = one_blank(x)
        return x.replace(f" {self.edge}", self.edge).replace(f"{self.edge} ", self.edge) if self.edge else x


_SIGN_WORDS = {"≈": "approx", "≤": "le", "≥": "ge", "√": "sqrt", "×": "times", "÷": "divide"}
#: fixed values: signs of letters that were decoded wrongly, and the codes of doubts with what raises them
_TELLTALES = "âÂÃ"
_SUBSCRIPT_DOUBTS = ["�", "â‚", "₍", "₎", "₊", "₋", "₌"]
_SUPERSCRIPT_DOUBTS = ["�", "Â²", "Â³", "â\u0081"]
_MERGED_LOG = re.compile(r"[lL](?<!\w.)[oO][gG]_\d\d")
_GLUED_LOG = re.compile(r"[lL](?<!\w.)[oO][gG]_\d{2,}(?=(?i:[a-z]))")
_MERGED_BASE = re.compile(rf"{_LOG}[{tx.SUBSCRIPTS}]+(?=\d)")
_UNCLEAR_LOG = re.compile(r"\blog\s*\d+[A-Za-z(]", re.IGNORECASE)
_SCIENCE_DOUBTS = {
    "ambiguous_science_formula_case": re.compile(r"\b(?:Co\d|No\d|So\d)\b"),
    "ambiguous_unit_boundary": re.compile(r"\bms\b"),
    "merged_science_token": re.compile(r"[A-Z][a-z]?\d+[A-Za-z]"),
}

_SPOKEN = re.compile(rf"\blog_(?P<base>\d+)\b|\^(?P<power>\d+)|(?P<sign>[{''.join(_SIGN_WORDS)}])|[^A-Za-z0-9\s]+", re.IGNORECASE)


class Forms(NamedTuple):
    display: str
    canonical: str | None
    matcher: str
    warnings: list[str]


FORMS = T.StructType([T.StructField("display", T.StringType()), T.StructField("canonical", T.StringType()), T.StructField("matcher", T.StringType()), T.StructField("warnings", T.ArrayType(T.StringType()))])


def one_blank(x: str) -> str:
    return " ".join(x.split())


def repaired(x: str) -> str:
    """Text that was decoded wrongly read again, where that leaves fewer of the tell-tale letters."""
    bad = lambda s: sum(map(s.count, _TELLTALES))
    if x.isascii() or not bad(x):
        return x
    try:
        again = x.encode("cp1252").decode("utf-8")
        x = again if bad(again) < bad(x) else x
    except UnicodeError:
        pass
    return x.replace("Â²", "²").replace("Â³", "³")


_ONE, _MANY = Rules(), Rules(_EDGE)


def displayed(source: str, rules: Rules = _ONE) -> str:
    """Raised digits as ^n, lowered ones after log as _n, and one blank about signs: none at the ends of a text, after an
    opening bracket, before a closing one or a power."""
    x = rules.based.sub(lambda m: f"{m[1]}_{m[2].translate(_BASES)}{' ' if m[3] else ''}", source)
    x = rules.power.sub(r"^\g<0>", rules.glued.sub(r"log\1 ", x))
    for raised, digit in zip(tx.SUPERSCRIPTS, tx.DIGITS, strict=True):
        x = x.replace(raised, digit)
    for sign in _SIGNS:
        x = x.replace(sign, f" {sign} ")
    return rules.one_blank(x).replace("( ", "(").replace(" )", ")").replace(" ^", "^")


def _canonical_log(base: str, arg: str) -> str:
    return f"log(base={''.join(base.split())},arg={''.join(arg.split())})"


def _from_written(x: str) -> str | None:
    """A text whose logarithms, if it names any, stand in canonical form, however loosely set."""
    flat = one_blank(repaired(x)).replace("argz", "arg")
    if "log" not in flat.casefold():
        return flat or None
    return _written_logs(flat)


def _written_logs(flat: str) -> str | None:
    out, found = _ONE.written_log.subn(lambda m: _canonical_log(m[1], m[2]), flat)
    return (one_blank(out) or None) if found else None


def _logs_of_display(display: str, rules: Rules = _ONE) -> str:
    """log_b (x) and log_b x as log(base=b,arg=x)."""
    both = lambda m: _canonical_log(m[1], m[2])
    return rules.one_blank(rules.log_of_term.sub(both, rules.log_of_bracket.sub(both, display)))


def _from_display(display: str) -> str | None:
    """The canonical form of what is shown; none if there is no logarithm with a base."""
    out = _logs_of_display(display)
    return out if out != display else None


def spoken(display: str) -> str:
    """Bases and powers spelled out, some signs as words, all else letters and digits."""

    def word(m: re.Match) -> str:
        if m["base"]:
            return f"log base {m['base']}"
        return f" power {m['power']}" if m["power"] else f" {_SIGN_WORDS[m['sign']]} " if m["sign"] else " "

    return one_blank(_SPOKEN.sub(word, display))


def common_log(x: str, rules: Rules = _ONE) -> str:
    """log without a base, lg and log(base=10,arg=x) all read log base 10; other bases and ln stay."""
    ten = lambda m: f"log base 10 {''.join(m[2].split())}" if "".join(m[1].split()) == "10" else m[0]
    if "l" in x or "L" in x:
        x = rules.common_log.sub("log base 10", rules.written_log.sub(ten, x))
    return rules.one_blank(x)


def _doubts(source: str, display: str, canonical: str | None, wanted: bool) -> list[str]:
    found: set[str] = set()
    if not source.isascii():
        if any(map(source.__contains__, _SUBSCRIPT_DOUBTS)):
            found.add("subscript_decoding_uncertain")
        if any(map(source.__contains__, _SUPERSCRIPT_DOUBTS)):
            found.add("superscript_decoding_uncertain")
    return sorted(found.union(_log_doubts(repaired(source), display, canonical, wanted)))


def _log_doubts(read: str, display: str, canonical: str | None, wanted: bool) -> list[str]:
    shows = "log" in display.casefold()
    if not shows and "log" not in read.casefold():
        return []
    found: list[str] = []
    merged = _MERGED_LOG.search(display)
    if not canonical and (_UNCLEAR_LOG.search(read) or _UNCLEAR_LOG.search(display)):
        found.append("ambiguous_log_base_argument")
    if merged and _GLUED_LOG.search(display):
        found.append("ambiguous_log_base_attachment")
    if wanted and canonical is None and shows:
        found.append("canonical_math_missing")
    if merged or _MERGED_BASE.search(read):
        found.append("merged_log_base_operand")
    return found


def math_forms(source: str | None, given: str | None = None, canonical: bool = True) -> Forms:
    """All forms of a formula. ``given``: a canonical form from elsewhere, which goes first if it can be read."""
    source = source or ""
    display = displayed(repaired(source))
    form = None
    if canonical:
        form = (_from_written(given) if given else None) or _from_written(source) or _from_display(display)
    return Forms(display, form, form or spoken(display), _doubts(source, display, form, canonical))


def matched_on(source: str | None, given: str | None = None) -> str:
    """What a text of mathematics is matched on: dashes and odd blanks are plain, common logarithms all read the same."""
    flat = one_blank(source or "")
    flat = flat if flat.isascii() else flat.translate(_PLAIN)
    form = (_from_written(given) if given else None) or _from_written(flat)
    if not form:
        display = displayed(repaired(flat))
        form = _from_display(display) or spoken(display)
    return common_log(form)


def content_forms(source: str | None, kind: str | None, mathematics: bool) -> Forms:
    """The forms of a text by its kind of content: formulas as above, prose with plain quotes and stops."""
    source = source or ""
    if kind not in ("symbolic", "science_notation"):
        plain = unicodedata.normalize("NFKC", source).translate(str.maketrans("‘’“”", "''\"\""))
        display = one_blank(re.sub(r"\s+([,.;:?!])", r"\1", plain))
        return Forms(display, None, one_blank(re.sub(r"[^A-Za-z0-9\s]+", " ", display)).casefold(), [] if display else ["empty_text"])
    forms = math_forms(source, canonical=mathematics)
    if kind == "science_notation":
        doubts = {code for code, pattern in _SCIENCE_DOUBTS.items() if pattern.search(forms.display)}
        if "CO2" not in forms.display and re.search(r"\bCo2\b", forms.display):
            doubts.add("ambiguous_science_formula_case")
        if "�" in source:
            doubts.add("unicode_decoding_uncertain")
        forms = forms._replace(warnings=sorted(doubts.union(forms.warnings)))
    return forms._replace(matcher=common_log(forms.matcher)) if mathematics else forms


def all_forms(texts: list[str | None]) -> list[tuple[Forms, str]]:
    """``math_forms`` of each text and what it is ``matched_on``, all of them read as one."""
    if not texts:
        return []
    sources = [x or "" for x in texts]
    whole = _EDGE.join(sources)
    if whole.count(_EDGE) >= len(sources):
        alone = [_EDGE in x for x in sources]
        rest = iter(all_forms([x for x, own in zip(sources, alone, strict=True) if not own]))
        return [(math_forms(x), matched_on(x)) if own else next(rest) for x, own in zip(sources, alone, strict=True)]
    flat = _MANY.one_blank(whole)
    same = (flat.translate(_PLAIN) if _ODD.search(flat) else flat).split(_EDGE)
    reads, read, read_flat = sources, whole, flat
    if any(map(whole.__contains__, _TELLTALES)):
        reads = [repaired(x) for x in sources]
        read = _EDGE.join(reads)
        read_flat = _MANY.one_blank(read)
    shown = displayed(read, _MANY)
    logs, displays = _logs_of_display(shown, _MANY).split(_EDGE), shown.split(_EDGE)
    odd = any(map(whole.__contains__, _SUBSCRIPT_DOUBTS + _SUPERSCRIPT_DOUBTS))
    forms: list[Forms] = []
    for source, x, display, log in zip(reads, read_flat.replace("argz", "arg").split(_EDGE), displays, logs, strict=True):
        low = x.casefold()
        if "log" not in low:
            form = x or None
        else:
            form = _written_logs(x) if "base" in low else None
            if not form and log != display:
                form = log
        forms.append(Forms(display, form, form or spoken(display), _log_doubts(source, display, form, True)))
    if odd:
        forms = [f._replace(warnings=_doubts(x, f.display, f.canonical, True)) for x, f in zip(sources, forms, strict=True)]
    matched = common_log(_EDGE.join(f.matcher for f in forms), _MANY).split(_EDGE)
    return [(f, m if a == x else matched_on(x)) for f, m, a, x in zip(forms, matched, same, sources, strict=True)]


def _frame(rows: list[Forms]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=FORMS.fieldNames())


_FORM_FIELDS = pa.struct([("display", pa.string()), ("canonical", pa.string()), ("matcher", pa.string()), ("warnings", pa.list_(pa.string())), ("matched", pa.string())])
#: fixed value: characters of text whose forms are held at once
MOST_AT_ONCE = 1 << 21
#: fixed value: formulas that are read as one
MOST_TEXTS = 1000


def _as_arrow(texts: list[str | None]) -> pa.StructArray:
    found = all_forms(texts)
    columns = [*zip(*(f for f, _ in found), strict=True), [m for _, m in found]] if found else [[]] * len(_FORM_FIELDS)
    return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FORM_FIELDS, strict=True)], fields=list(_FORM_FIELDS))


@F.arrow_udf(T.StructType([*FORMS.fields, T.StructField("matched", T.StringType())]))
def math_normalised(source: pa.Array) -> pa.Array:
    """All forms of formulas, and what they are ``matched`` on."""
    return pa.concat_arrays([_as_arrow(source[i : i + MOST_TEXTS].to_pylist()) for i in range(0, max(1, len(source)), MOST_TEXTS)])


def _formed(batches: Iterator[pa.RecordBatch], source: int, most: int = MOST_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """Batches with the forms of one column's texts, in pieces of so many characters or of a single longer text."""
    for batch in batches:
        begin, held, texts = 0, 0, []
        for at in range(batch.num_rows):
            texts.append(batch.column(source)[at].as_py())
            held += len(texts[-1] or "")
            if held >= most or at + 1 == batch.num_rows:
                piece = batch.slice(begin, at + 1 - begin)
                yield pa.RecordBatch.from_arrays([*piece.columns, _as_arrow(texts)], names=[*batch.schema.names, "forms"])
                begin, held, texts = at + 1, 0, []


def with_math_forms(rows: DataFrame, source: str) -> DataFrame:
    """``rows`` with ``forms``, what ``math_normalised`` has, of whole documents: a task holds the forms of a few at once."""
    at = rows.columns.index(source)
    schema = T.StructType([*rows.schema.fields, T.StructField("forms", T.StructType([*FORMS.fields, T.StructField("matched", T.StringType())]))])
    return rows.mapInArrow(lambda batches: _formed(batches, at), schema)


@F.pandas_udf(FORMS)
def _content(source: pd.Series, kind: pd.Series, mathematics: pd.Series) -> pd.DataFrame:
    return _frame([content_forms(*row) for row in zip(source, kind, mathematics, strict=True)])


def content_normalised(source: Column, kind: Column, subject: Column) -> Column:
    """display, canonical, matcher and warnings of a text of the kind of content that ``text.content_type`` tells."""
    #: fixed value: the subject whose logarithms are read
    return _content(source, kind, F.coalesce(F.lower(tx.one_line(subject)) == "mathematics 1014", F.lit(False)))
