"""Expressions over scanned pages, question lines, paper names and nested answer structures."""

from __future__ import annotations

import functools
import unicodedata

import pandas as pd
from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from markwright.functions.text import fold, normalize, tokens


def words(x: Column) -> Column:
    return F.filter(F.split(F.trim(x), r"\s+"), lambda w: w != "")


def word_estimate(x: Column) -> Column:
    """Words by count, or by characters (5.2 a word) where that says more."""
    return F.greatest(F.size(words(x)), F.round(F.length(F.trim(x)) / 5.2).cast("int"))


def middle(values: Column) -> Column:
    """The median of the positive values: the middle one, or the rounded mean of two; 0 if there is none."""
    good = F.array_sort(F.filter(values, lambda v: v > 0))
    n, at = F.size(good), F.floor(F.size(good) / 2).cast("int")
    return F.when(n == 0, 0).when(n % 2 == 1, F.get(good, at)).otherwise(F.bround((F.get(good, at - 1) + F.get(good, at)) / 2.0)).cast("int")


#: fixed values: what examiners write around a scheme, in this order
FURNITURE = [
    r"(?i)\b(any\s+)?(one|two|three|four|five|six|1|2|3|4|5|6)\s+from:?", r"(?i)\bworking space\b", r"(?i)\badditional guidance\b",
    r"(?i)\bmark scheme\b", r"(?i)\b(?:max|maximum)\s+\d+\s+from\b",
]


def scheme_usable(x: Column, least: int = 16) -> Column:
    """A marking scheme with enough letters and digits left once examiners' furniture is gone."""
    bare = x
    for pattern in FURNITURE:
        bare = F.regexp_replace(bare, pattern, " ")
    return F.length(F.regexp_replace(bare, "(?i)[^a-z0-9]", "")) >= least


def strip_controls(x: Column) -> Column:
    """Without control characters other than tab and line ends; also for JSON text, whose shape it keeps."""
    return F.regexp_replace(F.regexp_replace(x, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""), r"\\u00(0[0-8bcefBCEF]|1[0-9a-fA-F]|7[fF])", "")


@F.pandas_udf(T.StringType())
def _without_accents(x: pd.Series) -> pd.Series:
    """Letters of any script taken apart, and their marks left out."""
    bare = lambda s: "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c))
    return x.map(lambda s: s if s is None or s.isascii() else bare(s))


def name_slug(x: Column, most: int = 20) -> Column:
    """Accents off, lower case, letters and digits only."""
    return F.substring(F.regexp_replace(F.lower(_without_accents(x)), r"[^a-z0-9]", ""), 1, most)


#: fixed values: what publishers leave in texts: whole tails, sentences, marks of empty pages; and what scans leave at a start
TAILS = (
    r"(?i)(?=[aiedtpcf©])(?:Additional Pages?\s+If you use|If you use the following lined|END OF QUESTION PAPER|The boundaries and names shown|do not imply official endorsement|Copyright Acknowledgements?\b|Permission to reproduce items"
    r"|Every reasonable effort has been made|To avoid the issue of disclosure|Cambridge International Examinations is part of|Cambridge Assessment is the brand name|Cambridge Assessment International Education concerning|is freely available to download at www\.cie\.org\.uk|©\s*Ref:)"
)
NUMBERS_BEFORE = r"\s*(?:\b\d{1,3}\b\s+)*\z"
#: fixed values: words without which a text has no such tail, sentence or mark, in small letters
TAIL_WORDS = ["if you use", "question paper", "the boundaries", "official endorsement", "copyright ack", "permission to", "every reasonable", "the issue of", "cambridge ", "freely available", "ref:"]
SYNDICATE = r"(?:University of Cambridge Local |Local )?Examinations\s+Syndicate\s*\(UCLES\),?\s*which\s+(?:is\s+itself|itself\s+is|is)\s+a\s+department\s+of\s+the\s+University\s+of\s+Cambridge\.?"
LIVE_SERIES = r"\s*(?:at\s+www\.cambridgeinternational\.org\s+after\s+)?the\s+live\s+examination\s+series\.?"
START_NOISE = [r"(?i)^\s*(?:DFD)+\s*(?=[,.;:]{2,})", r"^\s*[,.;:]{2,}\s*"]


def without_boilerplate(x: Column) -> Column:
    """A text without what publishers and scans leave in it; publishers' tails go with all that follows them."""
    names = lambda c, words_: functools.reduce(lambda p, q: p | q, [F.lower(c).contains(w) for w in words_])
    parts = F.split(x, TAILS, 2)  # a text up to its first tail; the page numbers before that go with it
    x = F.when(names(x, TAIL_WORDS), F.when(F.size(parts) > 1, F.regexp_replace(F.get(parts, F.lit(0)), NUMBERS_BEFORE, "")).otherwise(x)).otherwise(x)
    for word, pattern in (("examination", rf"(?i){LIVE_SERIES}(?:\s*{SYNDICATE})?"), ("(ucles)", rf"(?i)\s*{SYNDICATE}"), ("blank page", r"(?i)\s*\bBLANK PAGE\b")):
        x = F.when(names(x, [word]), F.regexp_replace(x, pattern, " ")).otherwise(x)
    for pattern in START_NOISE:
        x = F.regexp_replace(x, pattern, "")
    return F.regexp_replace(x, r"^\s+", "")


def mcq_layout(x: Column) -> Column:
    """Options A to D in order somewhere in the text."""
    return x.rlike(r"(?s)\bA\b.+\bB\b.+\bC\b.+\bD\b")


#: fixed values: lines of papers that carry no content
LINE_NOISE = r"(?i)\bturn\s+over\b|\bcambridge\b|\bcuc?les\b|\bpage\s+\d+\s+of\s+\d+\b|\b(?:syllabus|published|candidate number|centre number)\b|\b\d{4}/\d{2}\b|\b\d{1,2}/\d{2}/[A-Z]/[A-Z]/\d{2}\b"
MCQ_NOISE = r"(?i)\bturn\s+over\b|\bcambridge\s+international\b|\bcuc?les\b|\bpage\s+\d+\s+of\s+\d+\b|\b(?:syllabus|mark scheme|published|copyright acknowledgements)\b|\b\d{4}/\d{2}\b|\b\d{1,2}/\d{2}/[A-Z]/[A-Z]/\d{2}\b"
#: fixed values: what shows that a page holds no questions, in this order
EXCLUDED = [("read these instructions first", "instructions_page"), ("periodic table of the elements", "periodic_table_page"), ("data sheet", "data_sheet_page"), ("blank page", "blank_page")]
#: fixed values: subjects that a printed header may name, in this order
HEADERS = [
    "additional mathematics", "english language", "pakistan studies", "business studies", "computer science", "environmental management", "art and design", "islamiyat", "islamiat", "chemistry", "biology", "physics",
    "mathematics", "economics", "accounting", "commerce", "history", "geography", "sociology",
]


def mcq_stem(x: Column) -> Column:
    """Reads like the stem of a multiple-choice question: three words or more with letters, and options, a question or a start."""
    y = F.trim(F.regexp_replace(x, r"\s+", " "))
    n = F.size(words(y))
    told = F.lower(y).rlike("which|what|how|statement|explain|describe")
    return ~y.rlike(MCQ_NOISE) & (n >= 3) & y.rlike("[A-Za-z]") & (y.rlike(r"(?i)\bA\b.*\bB\b.*\bC\b.*\bD\b") | y.contains("?") | told | (n >= 5) | y.rlike("^[A-Z]"))


def page_excluded(lines: Column) -> Column:
    """Why a page (its lines) holds no questions: a hint in its text, or little more than footers; null if it may."""
    text = F.lower(F.array_join(lines, "\n"))
    reason = None
    for hint, name in EXCLUDED:
        reason = F.when(text.contains(hint), name) if reason is None else reason.when(text.contains(hint), name)
    full = F.filter(lines, lambda s: F.trim(s) != "")
    noisy, letters = F.size(F.filter(full, lambda s: s.rlike(LINE_NOISE))), F.size(F.filter(full, lambda s: s.rlike("[A-Za-z]")))
    heavy = (F.size(lines) >= 8) & (noisy / F.greatest(F.size(lines), F.lit(1)) >= 0.85) & (letters <= 2)
    return reason.when(heavy, "footer_heavy_page")


def page_left_out(line: Column, page: WindowSpec) -> Column:
    """Whether ``page_excluded`` names a reason for a line's page, by counts over its lines: no hint goes over a line's end."""
    low = F.lower(line)
    hint = F.coalesce(low.contains(EXCLUDED[0][0]) | low.contains(EXCLUDED[1][0]) | low.contains(EXCLUDED[2][0]) | low.contains(EXCLUDED[3][0]), F.lit(False))
    full = F.trim(line) != ""
    n, noisy, letters = F.count(line).over(page), F.count_if(full & line.rlike(LINE_NOISE)).over(page), F.count_if(full & line.rlike("[A-Za-z]")).over(page)
    return F.max(hint).over(page) | ((n >= 8) & (noisy / F.greatest(n, F.lit(1)) >= 0.85) & (letters <= 2))


def ocr_noise(text: Column, width: Column, height: Column, least: float = 10.0) -> Column:
    """Texts of two characters at most, and boxes too small to hold any."""
    return F.coalesce((F.length(F.trim(text)) <= 2) | (width < least) | (height < least), F.lit(True))


def subject_from_header(header: Column) -> Column:
    return F.coalesce(*[F.when(F.lower(header).contains(s), s) for s in HEADERS])


def header_conflicts(header: Column, chosen: Column) -> Column:
    """Whether a printed header names another subject than the chosen one; neither may be part of the other."""
    bare = lambda x: F.trim(F.regexp_replace(F.lower(x), "[^a-z]+", " "))
    a, b = bare(subject_from_header(header)), bare(chosen)
    return F.coalesce((F.trim(chosen) != "") & ~a.contains(b) & ~b.contains(a), F.lit(False))


def anchored(text: Column, quoted: Column, least_words: int = 2) -> Column:
    """Whether a quotation stands in the text and is long enough to find it again."""
    return anchored_in(normalize(text), quoted, least_words)


def anchored_in(text: Column, quoted: Column, least_words: int = 2) -> Column:
    """``anchored`` in a text that is normalised once for all its quotations."""
    return (F.size(tokens(quoted)) >= least_words) & text.contains(normalize(quoted))


def flat(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " "))


def correction_holds(page: Column, quoted: Column, wrong: Column, right: Column) -> Column:
    """``correction_holds_in`` a page as it is."""
    return correction_holds_in(flat(page), quoted, wrong, right)


def correction_holds_in(text: Column, quoted: Column, wrong: Column, right: Column) -> Column:
    """Whether a correction can be placed and says something: its quotation, of two words in short lines and four in
    others, stands in the page and holds the wrong word, which stands alone in the page; and the two don't differ in
    signs and letter case only. ``text``: the page, made ``flat`` once for all its corrections; what is dear comes last."""
    q, a, b = flat(quoted), flat(wrong), flat(right)
    n = F.size(words(q))
    #: fixed values: up to four words are a short line
    long_enough = n >= F.when(n <= 4, 2).otherwise(4)
    alone = F.regexp_like(text, F.concat(F.lit(r"(?U)\b\Q"), F.replace(a, F.lit(r"\E"), F.lit("")), F.lit(r"\E\b")))
    bare = lambda c: F.regexp_replace(F.lower(c), r"(?U)\W+", "")
    return (q != "") & (a != "") & (b != "") & long_enough & q.contains(a) & (bare(a) != bare(b)) & text.contains(q) & alone


def context(text: Column, word: Column, around: int = 5) -> Column:
    """The words about the first place of a word."""
    all_ = words(text)
    at = F.array_position(all_, word).cast("int")
    return F.when(at > 0, F.array_join(F.slice(all_, F.greatest(F.lit(1), at - around), F.least(at - 1, F.lit(around)) + 1 + around), " "))


def bare(x: Column) -> Column:
    """Letters and digits alone."""
    return F.regexp_replace(F.lower(x), r"[^a-z0-9]+", "")


def on_page(page: Column, text: Column) -> Column:
    """``on_bare_page`` of a page as it is."""
    return on_bare_page(bare(page), text)


def on_bare_page(page: Column, text: Column, probe: int = 48, short: int = 24) -> Column:
    """Whether a page holds the start of a text, by letters and digits alone; a shorter start, which the longer one holds,
    decides. ``page``: made ``bare`` once for all its texts."""
    t = bare(text)
    return (t != "") & page.contains(F.substring(t, 1, min(probe, short)))


def in_main_band(y: Column, height: Column, top: float = 0.08, bottom: float = 0.92) -> Column:
    return (y / height).between(top, bottom)


def in_any_box(x: Column, y: Column, boxes: Column, pad: float = 0.0) -> Column:
    """A point in one of the boxes (x0, y0, x1, y1)."""
    return F.exists(boxes, lambda b: x.between(b["x0"] - pad, b["x1"] + pad) & y.between(b["y0"] - pad, b["y1"] + pad))


def path_key(path: Column) -> Column:
    """A path with its segments trimmed."""
    return F.array_join(F.transform(F.split(path, "/"), lambda p: F.trim(p)), "/")


def subject_matches(a: Column, b: Column) -> Column:
    """Equal, or one opens the other at a word's end."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    return (x == y) | x.startswith(F.concat(y, F.lit(" "))) | y.startswith(F.concat(x, F.lit(" ")))


def next_session(session_dates: Column, as_of: Column) -> Column:
    """The session (name, day) of the earliest day not before ``as_of``, else the latest."""
    ordered = F.array_sort(F.transform(session_dates, lambda s: F.struct(s["day"].alias("day"), s["name"].alias("name"))))
    return F.coalesce(F.get(F.filter(ordered, lambda s: s["day"] >= as_of), F.lit(0))["name"], F.element_at(ordered, -1)["name"])


def flat_parts(parts: Column) -> Column:
    """Parts and their subparts in order, labels joined: (a), (a)(i)."""
    return F.flatten(F.transform(parts, lambda p: F.concat(
        F.array(F.struct(p["label"].alias("label"), p["text"].alias("text"))),
        F.transform(F.coalesce(p["subparts"], F.array().cast("array<struct<label:string,text:string>>")), lambda s: F.struct(F.concat(p["label"], s["label"]).alias("label"), s["text"].alias("text"))),
    )))


def options_from_list(options: Column) -> Column:
    """Texts as (label, text) with letters from A."""
    return F.transform(options, lambda t, i: F.struct(F.chr(i + 65).alias("label"), t.alias("text")))


def options_from_map(options: Column) -> Column:
    return F.transform(F.array_sort(F.map_entries(options)), lambda e: F.struct(e["key"].alias("label"), e["value"].alias("text")))


def question_images(images: Column) -> Column:
    """Sources of images that don't show the answer."""
    return F.transform(F.filter(images, lambda i: ~i["role"].eqNullSafe(F.lit("answer"))), lambda i: F.coalesce(i["src"], i["url"]))


def answer_slots(question_id: Column, answers: Column) -> Column:
    """Answers by ``id::index``."""
    return F.map_from_entries(F.transform(answers, lambda a, i: F.struct(F.concat_ws("::", question_id, i.cast("string")), a)))


def foreign_paper(expected: Column, seen: Column) -> Column:
    """Whether the numbers seen belong to another paper: none match, or most are foreign and few match."""
    matched = F.size(F.array_intersect(expected, seen)) / F.greatest(F.size(expected), F.lit(1))
    foreign = F.size(F.array_except(seen, expected)) / F.greatest(F.size(F.array_distinct(seen)), F.lit(1))
    return (F.size(seen) > 0) & ((matched == 0) | ((foreign >= 0.7) & (matched < 0.2)))


def retry_blocked(rejected_at: Column, as_of: Column, hours: int = 24) -> Column:
    return rejected_at.isNotNull() & (as_of < rejected_at + F.make_dt_interval(F.lit(0), F.lit(hours)))


def escalate(is_pdf: Column, confidence: Column, flags: Column, ambiguous: list[str], at: float = 0.75) -> Column:
    """Whether a second reading is worth it."""
    return is_pdf & ((confidence < at) | F.arrays_overlap(flags, F.array(*map(F.lit, ambiguous))))


def repair_accepted(before: Column, after: Column, rivals: Column) -> Column:
    """A repaired reading counts only if its score did not fall and still leads."""
    return (after >= before) & (after >= F.coalesce(F.array_max(rivals), F.lit(0.0)))
